"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over how often each pattern
of votes occurs, counted on all documents, estimates every labeller's accuracy and coverage and the share of good
documents; it needs no true labels. The posterior of a document's pattern is its soft label. A linear scorer over
hashed features of the words' shapes and of the text's make-up learns the soft labels on a bounded sample, then scores
every whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from wareloom.llm.common import Scratch, held, in_slices, with_own_names

FEATURES, SAMPLE, EPOCHS, SEED = 1 << 10, 3_000, 8, 3
#: Documents that score less are rejected.
THRESHOLD = 0.5
#: A word of more bytes counts as several words where a measure is per word: text without blanks isn't one word.
LONGEST_WORD = 32
#: Capitals are a share of as many letters at least: the capital that opens a text of one word isn't shouting.
FEW_LETTERS = 20
#: Words whose features a worker remembers.
REMEMBERED = 100_000
LABELLERS = ("symbols", "marked", "capitals", "shouting", "repeats", "common", "bars", "sentences")


_SYMBOLS = np.frombuffer(b"#$%&*@^~=<>{}[]_\\", dtype=np.uint8)


def measures(words: list[str], text: str) -> tuple:
    """What the labellers look at, over a whole text: symbols per byte and per word, capitals among letters,
    exclamation marks per word, share of repeated words, share of the three most common, bars and sentence ends per
    word, words. Per word means per LONGEST_WORD bytes where the words are longer than that on average."""
    n = len(words)
    if not n:
        return (0.0,) * 8 + (0,)
    counts = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    upper, lower, symbols = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[_SYMBOLS].sum())
    times = Counter(words)
    common = sum(nlargest(3, times.values())) / n
    size = int(counts.sum())
    per = max(n, size / LONGEST_WORD)
    return (
        symbols / size, symbols / per, upper / max(FEW_LETTERS, upper + lower), int(counts[33]) / per,
        1 - len(times) / n - min(0.3, n / 20_000), common, int(counts[124]) / per, int(counts[[46, 33, 63]].sum()) / per, n,
    )


def votes(text: str | None) -> list[int]:
    """One vote per labeller: 1 good, -1 bad, 0 none, 2 if it can't judge: a share among few words tells nothing, and a
    text without words nothing at all."""
    symbols, marked, capitals, shouts, repeats, common, bars, ends, n = measures((text or "").split(), text or "")
    if not n:
        return [2] * len(LABELLERS)
    long = n >= 30
    return [
        -1 if symbols > 0.04 else 0,
        -1 if marked > 0.4 else 1 if marked < 0.1 else 0,
        -1 if capitals > 0.4 else 0,
        -1 if shouts > 0.3 else 1 if shouts < 0.05 else 0,
        2 if not long else -1 if repeats > 0.45 else 0,
        2 if not long else -1 if common > 0.4 else 1 if common < 0.3 else 0,
        -1 if bars > 0.25 else 0,
        1 if ends >= 0.03 else 2 if not long else -1 if ends < 0.02 else 0,
    ]


def _row_hash() -> Column:
    return F.xxhash64("doc_id", "text").alias("h")


def vote_table(docs: DataFrame) -> DataFrame:
    """h (hash of doc_id and text) and pattern (the votes as a string of +, -, 0 and . for 2) of each row of ``docs``."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in in_slices(batches):
            marks = ["".join("0+.-"[v] for v in votes(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(marks, pa.string())], ["h", "pattern"])

    return docs.select(_row_hash(), "text").mapInArrow(scan, "h long, pattern string")


def _matrix(patterns: list[str]) -> np.ndarray:
    return np.array([[{"0": 0, "+": 1, "-": 2, ".": 3}[c] for c in p] for p in patterns], dtype=np.int64)


class LabelModel:
    """Chances of each vote given good or bad, and the share of good documents, by expectation-maximisation.

    A labeller's votes are taken as independent given the class; one that can't judge is left out, for good or bad.
    The start favours votes that say the class.
    """

    def __init__(self, labellers: int = len(LABELLERS)):
        self.chance = np.tile(np.array([[0.5, 0.49, 0.01], [0.4, 0.2, 0.4]]), (labellers, 1, 1))
        self.good = 0.8

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) for each row of votes (0 none, 1 good, 2 bad, 3 can't judge)."""
        chance = np.concatenate((self.chance, np.ones((len(self.chance), 2, 1))), axis=2)
        logs = np.log([self.good, 1 - self.good]) + sum(np.log(chance[j][:, votes[:, j]]).T for j in range(votes.shape[1]))
        top = logs.max(axis=1, keepdims=True)
        parts = np.exp(logs - top)
        return parts[:, 0] / parts.sum(axis=1)

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
        for _ in range(rounds if len(votes) else 0):
            p = self.posterior(votes)
            share = np.array([p * counts, (1 - p) * counts])
            self.good = float(np.clip((share[0].sum() + 0.9) / (counts.sum() + 1), 1e-3, 1 - 1e-3))
            for j in range(votes.shape[1]):
                # a few imagined votes that agree with the class keep every chance above 0
                seen = np.array([[np.bincount(votes[:, j], weights=w, minlength=4)[:3]] for w in share])[:, 0] + np.array([[0.5, 0.49, 0.01], [0.4, 0.2, 0.4]])
                self.chance[j] = seen / seen.sum(axis=1, keepdims=True)
        return self

    def accuracies(self) -> np.ndarray:
        """How often each labeller's vote is right, where it votes."""
        right = self.good * self.chance[:, 0, 1] + (1 - self.good) * self.chance[:, 1, 2]
        voted = self.good * self.chance[:, 0, 1:].sum(axis=1) + (1 - self.good) * self.chance[:, 1, 1:].sum(axis=1)
        return right / voted


_EDGES = "#$%&*@^~=<>{}[]_|!?.,;:()'\"-+/\\"


def word_feature(word: str) -> int:
    """The hashed feature of a word: the case of its letters, and the marks before and after them."""
    core = word.strip(_EDGES)
    at = word.find(core) if core else 0
    case = "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "0" if core.isdigit() else "T" if core else "-"
    shape = f"{word[:at][:2]}{case}{word[at + len(core) :][:3]}"
    return 16 + zlib.crc32(shape.encode()) % (FEATURES - 16)


class Shapes(dict):
    """Features of words, remembered for up to REMEMBERED of them."""

    def __missing__(self, word: str) -> int:
        self[word] = number = word_feature(word)
        return number

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of a whole text's features: 16 for its make-up, the others for its words' shapes."""
    words = (text or "").split()
    if not words:
        return np.array([0]), np.array([1.0])
    shapes = held(("shapes",), Shapes)
    counts = np.bincount(shapes.of(words), minlength=FEATURES)
    ids = np.flatnonzero(counts)
    got = list(measures(words, text)[:8])
    got[5] -= min(1, 3 / len(words))  # few words are few different ones at best
    return np.concatenate((np.arange(9), ids)), np.concatenate(([1.0], got, np.sqrt(counts[ids] / len(words))))


class Scorer:
    """Logistic scorer over hashed features."""

    def __init__(self):
        self.w = np.zeros(FEATURES)

    def score(self, text: str | None) -> float:
        ids, weights = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.w[ids] @ weights, -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, times: np.ndarray) -> Scorer:
        """``rows``: what ``features`` gives for each text learned from."""
        order, pace = np.random.default_rng(SEED), np.full(FEATURES, 1e-6)
        for _ in range(EPOCHS):
            for k in order.permutation(len(rows)):
                ids, weights = rows[k]
                wrong = 1 / (1 + np.exp(-np.clip(self.w[ids] @ weights, -30, 30))) - target[k]
                step = times[k] * (wrong * weights + 1e-4 * self.w[ids])
                pace[ids] += step * step
                self.w[ids] -= 0.3 * step / np.sqrt(pace[ids])
        return self


def _feature_table(docs: DataFrame) -> DataFrame:
    """h, and the numbers and weights of the features of each row of ``docs`` (h, text)."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in in_slices(batches):
            rows = [features(t) for t in batch.column("text").to_pylist()]
            cells = [pa.array([x.astype(kind).tobytes() for x in xs], pa.binary()) for xs, kind in zip(zip(*rows), ("<i2", "<f4"))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("h"), *cells], ["h", "ids", "weights"])

    return docs.mapInArrow(scan, "h long, ids binary, weights binary")


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """The label model of all of ``docs`` (doc_id, text) and a scorer learned from up to ``sample`` of them.

    The driver gets one count per vote pattern (4 to the number of labellers at most), and a sample in which good
    and bad documents, by posterior, have equal room: those with the smallest hashes of doc_id and text. Of a sampled
    text it gets the features, FEATURES numbers at most however long the text is.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    table = scratch.write(vote_table(docs), "votes")
    seen = [(r[0], r[1]) for r in table.groupBy("pattern").count().collect()]
    patterns, counts = [p for p, _ in seen], np.array([c for _, c in seen], dtype=float)
    marks = _matrix(patterns).reshape(len(patterns), len(LABELLERS))
    model = LabelModel().fit(marks, counts)
    label = dict(zip(patterns, model.posterior(marks).tolist(), strict=True)) if patterns else {}
    chosen: dict[int, float] = {}
    for good in (True, False):
        own = [p for p in patterns if (label[p] >= 0.5) == good]
        share = 4 * sample / max(1, sum(c for p, c in seen if p in own))
        # by hash about four times the sample's share of the rows, then exactly its number of different ones
        picked = table.where(F.col("pattern").isin(own) & (F.pmod("h", F.lit(1_000_000)) <= share * 1_000_000)).distinct()
        chosen |= {r[0]: label[r[1]] for r in picked.orderBy("h").limit(sample // 2).collect()}
    scratch.drop(table)
    if not chosen:
        return model, Scorer()
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], "h long")
    found = _feature_table(docs.select(_row_hash(), "text").join(F.broadcast(ids), "h")).dropDuplicates(["h"]).collect()
    found.sort(key=lambda r: r[0])
    rows = [(np.frombuffer(r[1], "<i2").astype(np.int64), np.frombuffer(r[2], "<f4").astype(float)) for r in found]
    goal = np.array([chosen[r[0]] for r in found])
    n_good, n_bad = max(1, int((goal >= 0.5).sum())), max(1, int((goal < 0.5).sum()))
    times = np.where(goal >= 0.5, len(goal) / (2 * n_good), len(goal) / (2 * n_bad))
    return model, Scorer().fit(rows, goal, np.minimum(times, 4))


def _scores(scorer: Scorer, texts: list[str | None]) -> list[float]:
    return [round(scorer.score(t), 6) if t and not t.isspace() else 1.0 for t in texts]


def score_quality(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with quality (0 to 1) and rejected (quality < threshold); the two are replaced where they exist.

    Needs doc_id and text; other columns pass through. Null texts and those without any word aren't judged:
    quality 1, kept; every other text is, however short. Repeated rows get the same score. An empty table stays empty.
    """
    plain, back = with_own_names(docs.drop("quality", "rejected"), ("quality", "rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), sample)[1])

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in in_slices(batches):
            score = _scores(shared.value, batch.column("text").to_pylist())
            yield batch.append_column("quality", pa.array(score, pa.float64())).append_column(
                "rejected", pa.array([s < threshold for s in score], pa.bool_())
            )

    more = [StructField("quality", DoubleType()), StructField("rejected", BooleanType())]
    out = plain.mapInArrow(scan, StructType([*plain.schema.fields, *more]))
    return back(out, "quality", "rejected")


def keep_good(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` doesn't reject, with the columns they have, whatever their names."""
    plain, back = with_own_names(docs, ())
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), sample)[1])

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in in_slices(batches):
            score = _scores(shared.value, batch.column("text").to_pylist())
            yield batch.filter(pa.array([s >= threshold for s in score], pa.bool_()))

    return back(plain.mapInArrow(scan, plain.schema))
