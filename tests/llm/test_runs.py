import hashlib
import random
import zlib

import pandas as pd
import pytest

from wareloom.llm.queries import QUERIES
from wareloom.llm.runs import LEAST, TIMES, collapse, collapse_runs, digests, find_runs, folded, lyndon_edges, runs_of

SF = "/root/testdata/sf0.001"


def brute(x, least=LEAST, times=TIMES):
    """Runs by trying every period at every place."""
    n, out = len(x), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q):
                w = x[i : i + length]
                if all(any(w[k] != w[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def random_text(r):
    n, s = r.choice([0, 1, 2, 5, 12, 30, 60]), r.choice([1, 2, 3])
    x = [r.randrange(s) for _ in range(n)]
    if r.random() < 0.6:
        root = [r.randrange(s + 1) for _ in range(r.randint(1, 6))]
        x = (x[: r.randint(0, 5)] + root * r.randint(2, 7) + x)[:90]
        x += x[: r.randint(0, len(x))] if r.random() < 0.5 else []
    return x


def test_lyndon_arrays():
    for seed in range(1500):
        x = random_text(random.Random(seed))
        follower, common, _ = lyndon_edges(x)
        for i in range(len(x)):
            j = next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x))
            k = 0
            while j + k < len(x) and x[i + k] == x[j + k]:
                k += 1
            assert (follower[i], common[i]) == (j, k), (x, i)


def test_words_compared_are_in_proportion_to_the_text():
    n = 20_000
    fibonacci, b = [0], [0, 1]
    while len(b) < n:
        fibonacci, b = b, b + fibonacci
    nested, rulers = [0], [0]
    while len(nested) < n:
        nested, rulers = nested * 2 + [len(nested) % 3], rulers + [len(rulers).bit_length()] + rulers
    texts = [
        [0] * n, [0, 1] * (n // 2), [0] * (n // 2) + [1] + [0] * (n // 2), b, [bin(k).count("1") & 1 for k in range(n)], nested, rulers, list(range(n)),
        [v for k in range(200) for v in [1] + [0] * k], [v for k in range(200) for v in [0] * k + [1]], ([0] * 140 + [1]) * 140, [random.Random(1).randrange(2) for _ in range(n)],
    ]
    for x in texts:
        assert max(lyndon_edges(x)[2], lyndon_edges([-v for v in x])[2]) <= 2.5 * len(x)


def test_runs_against_brute_force():
    for seed in range(3000):
        x = random_text(random.Random(seed))
        assert find_runs(x) == brute(x), x


def test_runs_of_many_texts_at_once():
    r = random.Random(5)
    texts = [[b"%d" % v for v in random_text(r)] for _ in range(400)]
    texts += texts[:20] + [[]]
    for words, runs in runs_of(texts):
        assert runs == brute(words)
        gone = {k for s, length, p in runs for k in range(s + p, s + length)}
        assert collapse(words, runs) == [w for k, w in enumerate(words) if k not in gone]


@pytest.mark.parametrize("many", [False, True])
def test_op13(spark, many):
    if many:
        docs = pd.DataFrame([(k, " ".join(map(str, random_text(random.Random(k)))) if k % 9 else None) for k in range(600)], columns=["doc_id", "text"])
        found = digests(collapse_runs(spark.createDataFrame(docs, "doc_id long, text string"), change=folded))
    else:
        docs, found = pd.read_parquet(f"{SF}/documents.parquet"), QUERIES["op13_periodic_runs"](spark, SF)
    got, seen = {r.doc_id: r for r in found.collect()}, 0
    assert len(got) == len(docs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        words = text.encode().split(None) if isinstance(text, str) else []
        n, h = len(words), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
        runs = brute([numbers[w] for w in words]) if n < 1500 else find_runs([numbers[w] for w in words])
        row = got[doc]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        gone = {k for s, length, p in runs for k in range(s + p, s + length)}
        assert row.runs_sha256 == sha("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode())
        assert row.collapsed_sha256 == sha(b" ".join(w for k, w in enumerate(words) if k not in gone))
        seen += bool(runs)
    assert seen > 5


def test_texts_of_any_kind(spark):
    rows = [(1, None, "r"), (None, "", "r"), (2, " \t\n", None), (2, "a b " * 50_000, "r"), (3, "a a " * 3, "r"), (4, "x\x1cx " * 6, "r"), (4, "x\x1cx " * 6, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs string")
    out = collapse_runs(docs)
    assert out.columns == ["doc_id", "text", "runs", "collapsed_text"]
    got = [([tuple(x) for x in r.runs], r.collapsed_text) for r in out.collect()]
    assert got[:3] == [([], "")] * 3 and got[3] == ([(0, 100_000, 2)], "a b") and got[4] == ([], "a a a a a a")
    assert got[5] == got[6] == ([(0, 6, 1)], "x\x1cx")
    assert collapse_runs(docs.limit(0)).count() == 0
