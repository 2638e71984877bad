import random

import numpy as np
import pytest

from wareloom.llm import language_id
from wareloom.llm.language_id import ByteGRU


def plain_scores(model, raw):
    """Label probabilities of each byte of one text, step by step as the gates are defined."""
    w, h_ = model.w, model.hidden
    sums = np.tile(w["p"].astype(float), (len(raw), 1))
    for d, out, order in (("f", w["o"][:h_], range(len(raw))), ("b", w["o"][h_:], range(len(raw) - 1, -1, -1))):
        h = np.zeros(h_)
        for t in order:
            x, back = w["e"][raw[t]] @ w[f"x{d}"] + w[f"c{d}"], h @ w[f"h{d}"]
            z, r = (1 / (1 + np.exp(-(x + back)[k * h_ : (k + 1) * h_])) for k in (0, 1))
            h = z * h + (1 - z) * np.tanh(x[2 * h_ :] + r * back[2 * h_ :])
            sums[t] += h @ out
    e = np.exp(sums - sums.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_labels_equal_the_plain_network():
    model = ByteGRU(["a", "b", "c"])
    texts = [b"one short text", b"x", "größer und länger".encode(), b""]
    got = language_id.read(model, texts)
    for k, raw in enumerate(texts):
        want = plain_scores(model, raw).mean(axis=0) if raw else np.zeros(3)
        assert np.allclose(got[k], want, atol=1e-4)


def test_windows_cover_each_byte_once(monkeypatch):
    for name, value in (("STEP", 7), ("CONTEXT", 60), ("ROWS", 3)):
        monkeypatch.setattr(language_id, name, value)
    model, texts = ByteGRU(["a", "b"]), [b"forty bytes of text that is cut up a lot", b"tiny", bytes(range(60, 100))]
    got = language_id.read(model, texts)  # the context reaches over the whole text, so nothing is lost by the windows
    for k, raw in enumerate(texts):
        assert np.allclose(got[k], plain_scores(model, raw).mean(axis=0), atol=1e-4)


def test_gradients_equal_differences():
    model, random = ByteGRU(["a", "b"], hidden=3, embed=2), np.random.default_rng(1)
    bytes_, target = random.integers(0, 6, (4, 5)).astype(np.int16), np.array([0, 1, 1, 0])
    bytes_[1, 3:] = bytes_[3, 1:] = 256

    def loss():
        chances = [plain_scores(model, row[row < 256]) for row in bytes_]
        return -sum(np.log(c[:, t]).sum() for c, t in zip(chances, target, strict=True)) / (bytes_ < 256).sum()

    found = model.gradients(bytes_, target)
    for name, w in list(model.w.items()):
        model.w[name] = w = w.astype(float)
        for at in list(np.ndindex(w.shape))[:40]:
            ends = []
            for step in (1e-5, -1e-5):
                w[at] += step
                ends.append(loss())
                w[at] -= step
            assert found[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=2e-4)


def test_language(spark):
    r = random.Random(3)
    say = lambda ws, n=12: " ".join(r.choice(ws) for _ in range(n))
    german, english = ["der", "und", "nicht"], ["the", "and", "with"]
    rows = [(k, say(german) if k % 2 else say(english), "de" if k % 2 else "en") for k in range(80)] + [(90, None, "de"), (91, "who knows", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = [(1, "und der", "x"), (2, "the and", "x"), (3, None, "x"), (4, "12 ??", "x"), (5, "und" * 2000, "x"), (6, "", "x"), (None, "with the", "x"), (2, "the and", "y")]
    docs += [(7, say(english, 4000) + " " + say(german, 50), "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang_pred string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.predict(frame, model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "de", 2: "en", 3: "und", 4: "und", 5: "de", 6: "und", None: "en", 7: "en"}
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.predict(frame, model).count() == len(docs) and language_id.predict(frame.limit(0), model).count() == 0
    assert {x.lang_pred for x in language_id.predict(frame, None).collect()} == {"und"}
    assert language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
