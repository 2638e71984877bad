"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads whole texts, blanks and all, in windows of STEP bytes that overlap: CONTEXT more bytes on either side
bring both directions' states up to date before a window's own bytes are labelled. Every byte of every text is labelled
once; a document's probabilities are the mean over all its bytes.

Training is backpropagation through time on windows from anywhere in a bounded number of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.llm.common import bound_batches, in_slices

HIDDEN, EMBED, EPOCHS, BATCH, RATE, SEED = 8, 12, 4, 128, 0.01, 5
#: Steps of training at least, in more epochs where there is little to learn from; what the rate falls to.
LEAST_STEPS, FALL = 300, 0.15
#: Bytes that a window labels, and those it reads on either side for their state; rows of one run of the network.
STEP, CONTEXT, ROWS = 704, 64, 1024
#: Learned from, per language: about so many documents, and windows of so many bytes, from each document at most so many.
SAMPLE_DOCS, SAMPLE_WINDOWS, LEARNED_BYTES, PER_DOC = 400, 1_500, 96, 16
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class ByteGRU:
    """Two GRUs over byte embeddings, one per direction, and a softmax over their states at every position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, embed: int = EMBED, seed: int = SEED):
        random = np.random.default_rng(seed)
        make = lambda *s: (random.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.w = {"e": make(257, embed) * np.float32(8)}
        for d in "fb":
            self.w |= {f"x{d}": make(embed, 3 * hidden), f"h{d}": make(hidden, 3 * hidden), f"c{d}": np.zeros(3 * hidden, np.float32)}
        self.w |= {"o": make(2 * hidden, len(labels)), "p": np.zeros(len(labels), np.float32)}

    def _run(self, d: str, x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list]:
        """States (steps, rows, hidden) of one direction; ``live`` keeps the state where a stretch has no byte."""
        h_, n = self.hidden, x.shape[0]
        into = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, states, trace = np.zeros((x.shape[1], h_), np.float32), np.zeros((n, x.shape[1], h_), np.float32), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            back = h @ self.w[f"h{d}"]
            gates = _sigmoid(into[t, :, : 2 * h_] + back[:, : 2 * h_])
            z, r = gates[:, :h_], gates[:, h_:]
            c = np.tanh(into[t, :, 2 * h_ :] + r * back[:, 2 * h_ :])
            new = np.where(live[t][:, None], z * h + (1 - z) * c, h)
            trace.append((t, h, z, r, c, back[:, 2 * h_ :]))
            h = states[t] = new
        return states, trace

    def _scores(self, d: str, bytes_: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What one direction adds to the label scores: (labels, steps, rows). Rows are in falling order of ``sizes``, so
        at each step those that have a byte there come first, and the others' states stay 0."""
        h_, (rows, steps) = self.hidden, bytes_.shape
        into, half = self.w["e"] @ self.w[f"x{d}"] + self.w[f"c{d}"], np.float32(0.5)
        into_gates, into_c = into[:, : 2 * h_] * half, into[:, 2 * h_ :].copy()
        back_gates, back_c = self.w[f"h{d}"][:, : 2 * h_] * half, self.w[f"h{d}"][:, 2 * h_ :].copy()
        h, states, by_step = np.zeros((rows, h_), np.float32), np.zeros((steps, rows, h_), np.float32), bytes_.T.astype(np.intp)
        live = np.searchsorted(-sizes, -np.arange(steps), side="left").tolist()
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            k = live[t]
            gates, c = into_gates.take(by_step[t, :k], axis=0), h[:k] @ back_c
            gates += h[:k] @ back_gates
            np.tanh(gates, out=gates)
            gates += np.float32(1)
            gates *= half
            c *= gates[:, h_:]
            c += into_c.take(by_step[t, :k], axis=0)
            np.tanh(c, out=c)
            new = states[t, :k]
            np.subtract(h[:k], c, out=new)
            new *= gates[:, :h_]
            new += c
            h = states[t]
        out = self.w["o"][:h_] if d == "f" else self.w["o"][h_:]
        return (out.T @ states.reshape(-1, h_).T).reshape(-1, steps, rows)

    def label(self, bytes_: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Label probabilities (labels, steps, rows) of rows of bytes, in falling order of their ``sizes``."""
        scores = self._scores("f", bytes_, sizes)
        scores += self._scores("b", bytes_, sizes)
        scores += self.w["p"][:, None, None]
        scores -= scores.max(axis=0)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=0)
        return scores

    def gradients(self, bytes_: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        h_, live = self.hidden, bytes_.T < 256
        x = self.w["e"][bytes_.T]
        runs = {d: self._run(d, x, live) for d in "fb"}
        states = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        scores = states @ self.w["o"] + self.w["p"]
        scores = np.exp(scores - scores.max(axis=2, keepdims=True))
        wrong = scores / scores.sum(axis=2, keepdims=True)
        wrong[:, np.arange(len(target)), target] -= 1
        wrong *= live[:, :, None] / max(1, live.sum())
        g = {"o": np.einsum("trh,trk->hk", states, wrong), "p": wrong.sum((0, 1)), "e": np.zeros_like(self.w["e"])}
        above = wrong @ self.w["o"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            into = np.zeros((*x.shape[:2], 3 * h_), np.float32)
            g[f"h{d}"], later = np.zeros_like(self.w[f"h{d}"]), np.zeros((x.shape[1], h_), np.float32)
            for t, h, z, r, c, back in reversed(runs[d][1]):
                dh = later + above[t, :, k * h_ : (k + 1) * h_]
                on = live[t][:, None]
                dn = dh * on
                dz, dc = dn * (h - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
                dr = dc * back * r * (1 - r)
                into[t] = np.concatenate((dz, dr, dc), axis=1)
                side = np.concatenate((dz, dr, dc * r), axis=1)
                g[f"h{d}"] += h.T @ side
                later = dh * ~on + dn * z + side @ self.w[f"h{d}"].T
            g[f"x{d}"] = np.einsum("tre,trk->ek", x, into)
            g[f"c{d}"] = into.sum((0, 1))
            dx += into @ self.w[f"x{d}"].T
        np.add.at(g["e"], bytes_.T, dx)
        return g

    def fit(self, bytes_: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteGRU:
        """Adam over shuffled batches; the rate falls evenly from one epoch to the next."""
        epochs = max(epochs, -(-LEAST_STEPS * BATCH // max(1, len(target))))
        random = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(w) for k, w in self.w.items()}, {k: np.zeros_like(w) for k, w in self.w.items()}, 0
        for epoch in range(epochs):
            order = random.permutation(len(target))
            for a in range(0, len(order), BATCH):
                rows = order[a : a + BATCH]
                part = bytes_[rows]
                part = part[:, : max(1, int((part < 256).sum(axis=1).max()))]
                step += 1
                for k, g in self.gradients(part, target[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    rate = RATE * FALL ** (epoch / epochs)
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def padded(windows: list[bytes]) -> np.ndarray:
    out = np.full((len(windows), max(map(len, windows))), 256, dtype=np.int16)
    sizes = np.array([len(w) for w in windows])
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(windows), dtype=np.uint8)
    return out


def read(model: ByteGRU, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities over all bytes of each text; zeros for an empty one."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    raw, first = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(sizes) - sizes
    windows = -(-sizes // STEP)
    doc = np.repeat(np.arange(len(texts)), windows)
    own = (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)) * STEP
    begin, end = np.maximum(own - CONTEXT, 0), np.minimum(own + STEP + CONTEXT, sizes[doc])
    skip, size = own - begin, end - begin
    kept = np.minimum(own + STEP, sizes[doc]) - own
    begin += first[doc]
    order, sums = np.argsort(-size, kind="stable"), np.zeros((len(doc), len(model.labels)))
    for k in range(0, len(order), ROWS):
        at = order[k : k + ROWS]
        steps = np.arange(int(size[at[0]]))
        part = raw[np.minimum(begin[at][:, None] + steps, len(raw) - 1)]
        inside = (steps[:, None] >= skip[at]) & (steps[:, None] < (skip + kept)[at])
        sums[at] = np.einsum("ltr,tr->rl", model.label(part, size[at]), inside.astype(np.float32))
    out = np.zeros((len(texts), len(model.labels)))
    np.add.at(out, doc, sums)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-12)


def _learned_windows(known: DataFrame, shares: dict[str, float], per_doc: int, size: int) -> DataFrame:
    """(lang, h, window binary): windows from anywhere in the documents that their hashes choose; cut on the executors."""
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in shares.items()])
    chosen = known.withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in in_slices(batches):
            out: list[list] = [[], [], []]
            for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True):
                raw = text.encode()
                places = np.arange(0, max(1, len(raw) - size // 2), size)
                random = np.random.default_rng(h & ((1 << 62) - 1))
                if len(places) > per_doc:
                    places = random.choice(len(raw) - size, per_doc, replace=False)
                for a in places.tolist() if raw else []:
                    for column, value in zip(out, (lang, int(random.integers(1 << 62)), raw[a : a + size]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["lang", "h", "window"]
            )

    return chosen.select("lang", "h", "text").mapInArrow(cut, "lang string, h long, window binary")


def train(
    examples: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, size: int = LEARNED_BYTES, per_doc: int = PER_DOC
) -> ByteGRU | None:
    """A network fitted on the driver to ``examples`` (doc_id, text, lang), or None without any.

    It sees a bounded sample: of each language about ``sample_docs`` documents, chosen by hashes of doc_id and text, up
    to ``per_doc`` windows of ``size`` bytes from anywhere in each, and ``sample_windows`` of these. The driver gets the
    windows, not the texts. Rows with a null text or lang teach nothing.
    """
    known = examples.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = dict(sorted((r[0], r[1]) for r in known.groupBy("lang").count().collect()))
    if not counts:
        return None
    shares = {k: min(1.0, sample_docs / n) for k, n in counts.items()}
    rows = sorted(_learned_windows(known, shares, per_doc, size).collect(), key=lambda r: (r[1], r[2]))
    windows, target = [], []
    for k, lang in enumerate(counts):
        own = [bytes(r[2]) for r in rows if r[0] == lang][:sample_windows]
        windows += own
        target += [k] * len(own)
    if not windows:
        return None
    return ByteGRU(list(counts)).fit(padded(windows), np.array(target))


def predict(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text; nothing else is looked at).

    The label with the highest mean probability over the text's bytes, and that probability. A null text or one
    without letters is UNDETERMINED with score 0; so is every text without a model. Ties go to the first label.
    Repeated rows get the same label; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        for batch in in_slices(batches):
            texts = [t.encode() if model and t and _LETTER.search(t) else b"" for t in batch.column("text").to_pylist()]
            means, names, scores = read(model, texts) if model else None, [], []
            for k, raw in enumerate(texts):
                best = int(means[k].argmax()) if raw else 0
                names.append(model.labels[best] if raw else UNDETERMINED)
                scores.append(min(1.0, round(float(means[k][best]), 6)) if raw else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(label, "doc_id long, lang_pred string, score double")
