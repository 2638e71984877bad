"""The registered queries over the smallest tables, and operators on made-up data, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from wareloom.llm import decontamination, line_dedup, packing
from wareloom.llm.queries import PROBE, QUERIES
from wareloom.llm.tokens import WordEncoder, default_tokenizer

SF = "/root/testdata/sf0.001"
ENCODER = WordEncoder(default_tokenizer())


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def ids_of(texts):
    return [[*x.tolist(), 2] for x in ENCODER.whole([t if isinstance(t, str) else "" for t in texts])]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark):
    turns = read("conversations").sort_values(["conv_id", "turn"])
    want = defaultdict(list)
    for r in turns.itertuples():
        want[r.conv_id].append((r.role, r.text if isinstance(r.text, str) else ""))
    want[-7] = [("user", PROBE), ("assistant", PROBE)]
    got = {r.conv_id: r for r in QUERIES["op1_chat_format"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for k, own in want.items():
        loss = "".join(t for role, t in own if role == "assistant")
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        assert (got[k].n_turns, got[k].turns_sha256) == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), sha(loss)) and got[k].formatted_chars > len(loss)


def test_op4(spark):
    docs = read("documents")
    got = defaultdict(list)
    for r in QUERIES["op4_best_fit_packing"](spark, SF).collect():
        got[r.doc_id].append(r)
    places = defaultdict(list)
    for doc, ids in zip(docs.doc_id, ids_of(docs.text), strict=True):
        at = 0
        for k, r in enumerate(sorted(got[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == crc(ids[at : at + r.length])
            assert r.length <= 1024 and (r.length == 1024 or k == 0)
            places[r.sequence_id].append((r.offset, r.length))
            at += r.length
        assert at == len(ids) and (len(ids) > 1024 or len(got[doc]) == 1)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    counts = pd.Series([r.length for own in got.values() for r in own]).value_counts().to_dict()
    assert len(places) <= packing.lower_bound(counts, 1024) + 1


def test_op8(spark):
    docs = read("documents").sort_values("doc_id")
    got = {r.doc_id: r for r in QUERIES["op8_token_id_output"](spark, SF).collect()}
    at = 0
    for doc, ids in zip(docs.doc_id, ids_of(docs.text), strict=True):
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op9(spark):
    docs = read("documents").set_index("doc_id")
    got = QUERIES["op9_language_id"](spark, SF).collect()
    assert len(got) == len(docs)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    known = [(r.lang_pred, docs.lang[r.doc_id]) for r in held if isinstance(docs.lang[r.doc_id], str) and len(docs.text[r.doc_id] or "") > 20]
    assert sum(a == b for a, b in known) >= 0.97 * len(known)


def test_op5_against_labels(spark):
    """What the labels call bad goes and what they call good stays; the classifier never sees them."""
    labels = read("labels").set_index("doc_id").quality
    got = {r.doc_id: r.rejected for r in QUERIES["op5_quality_classifier"](spark, SF).collect()}
    bad, good = [got[k] for k in labels.index[labels == 0]], [got[k] for k in labels.index[labels == 1]]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)


def overlaps(text, items, window):
    """Hit words of a text, and the items found, by trying each window of each item at each place."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for key, item in items:
        parts = words(item)
        for k in range(max(1, len(parts) - window + 1) if parts else 0):
            phrase = parts[k : k + window]
            for a in range(len(own) - len(phrase) + 1):
                if own[a : a + len(phrase)] == phrase:
                    hit |= set(range(a, a + len(phrase)))
                    found.add(key)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_by_trial(spark, seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 200)
    word = lambda: r.choice(["a", "B", "c", "dé", "e1", "it's", "x-y"])
    items = [(str(k), " ".join(word() for _ in range(r.choice([0, 1, 2, 4, 7])))) for k in range(12)] + [("n", None)]
    docs = [(k, r.choice([" ", ", ", "\n"]).join(word() for _ in range(r.randint(0, 60)))) for k in range(60)] + [(99, None), (1, "a b c"), (1, "a b c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontamination.find_overlap(frame, spark.createDataFrame(items, "item_id string, text string"), window=3).collect()
    got = sorted((r.doc_id, r.text or "", r.n_words, r.n_hit, sorted(r.item_ids)) for r in found)
    assert got == sorted((k, t or "", *overlaps(t, items, 3)) for k, t in docs)


def one_word_apart(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_by_trial(spark, seed):
    r = random.Random(seed)
    base = [[r.choice("abcdefgh") for _ in range(r.randint(3, 8))] for _ in range(8)]

    def line():
        own = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2])):
            k = r.randrange(len(own))
            own[k : k + 1] = r.choice([[], [r.choice("abcdefgh")], [own[k], "z"]])
        return " " * r.randint(0, 1) + r.choice([" ", "\t"]).join(own)

    docs = [(k if k else None, "\n".join(line() for _ in range(r.randint(0, 6)))) for k in range(25)] + [(50, None)]
    every = [((k is not None, k or 0, n), raw.strip(" ")) for k, t in docs for n, raw in enumerate((t or "").split("\n")) if raw.strip()]
    first = {}
    for at, raw in sorted(every):
        first.setdefault(raw, at)
    words = {raw: re.split(r"[\t ]", raw.replace("\t", " ").strip()) for raw in first}
    near = {b for b in first if len(words[b]) >= 5 and any(first[a] < first[b] and len(words[a]) >= 5 and one_word_apart(words[a], words[b]) for a in first if a != b)}
    want = {(at[1] if at[0] else None, at[2]): raw in near and at == first[raw] for at, raw in every if raw in near or at != first[raw]}
    found = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), short_copies=True).collect()
    assert len(found) == len({(r.doc_id, r.line_no) for r in found})
    assert {(r.doc_id, r.line_no): r.near for r in found} == want


@pytest.mark.parametrize("name", ["op2_html_extraction", "op3_line_dedup", "op6_ngram_jaccard_join", "op7_embedding_near_dedup", "op10_benchmark_decontamination"])
def test_queries_return_a_row_for_each(spark, name):
    table, key = {"op2": ("pages", "page_id"), "op7": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    got = [r[key] for r in QUERIES[name](spark, SF).collect()]
    assert sorted(got) == sorted(read(table)[key])
