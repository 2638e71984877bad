import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wareloom.llm import chat, decontamination, embeddings, html_text, jaccard, line_dedup, packing, quality, token_store
from wareloom.llm.common import Scratch
from wareloom.llm.fm_index import FMIndex
from wareloom.llm.tokens import WordEncoder, default_tokenizer

ENCODER = WordEncoder(default_tokenizer())
DOCS = "doc_id long, text string, n_words string"


def corpus(n=60, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 5))) for _ in range(300)]
    base = [[r.choice(words) for _ in range(r.randint(1, 60))] for _ in range(n // 3)]
    out = []
    for k in range(n):
        own = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            own[r.randrange(len(own))] = r.choice(words)
        out.append((k, " ".join(own).replace(" ", "\n", 1) if k % 4 else " ".join(own).upper()))
    return [*out, (900, None), (901, ""), (902, "one"), (903, "one"), (904, " \t\n"), (None, "lost words here now today"), (905, "x " * 30_000)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "clash") for k, t in rows], DOCS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab' \n\té.<|>1 　")) | st.characters(codec="utf-8")), max_size=4))
def test_word_encoder_equals_the_library(texts):
    ids, counts = ENCODER.encode(pa.array(texts, pa.string()))
    want = ENCODER.whole(texts) if texts else []
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_word_encoder_forgets(spark):
    small, texts = WordEncoder(default_tokenizer(), 50), [" ".join(t.split(" ")[:80]) if t else t for _, t in corpus(90)]
    for k in range(0, len(texts), 7):
        ids, counts = small.encode(pa.array(texts[k : k + 7], pa.string()))
        want = ENCODER.whole([t or "" for t in texts[k : k + 7]])
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_store_round_trip(spark):
    rows = corpus()
    path = Scratch(spark, "test").path("store")
    token_store.write_store(frame(spark, rows), path, block_ids=500)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [x.tolist() + [2] for x in ENCODER.whole([t or "" for _, t in rows])]
    got = {r.doc_id: r for r in token_store.read_store(spark, path).collect()}
    at = 0
    for (k, _), own in zip(rows, ids, strict=True):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert {r.doc_id: r.ids for r in token_store.read_ids(spark, path).collect()} == {k: x for (k, _), x in zip(rows, ids, strict=True)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=300))
def test_elias_fano(gaps):
    values = np.concatenate(([0], np.cumsum(gaps)))
    code = token_store.EliasFano.of(values)
    assert code.all().tolist() == values.tolist()
    assert code.select(np.arange(len(values))).tolist() == values.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=40))
def test_packing_plan(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    plan = packing.plan_sequences(counts, 64, 2000)
    used = {}
    for bin_, times in plan:
        assert sum(bin_) <= 64
        for s in bin_:
            used[s] = used.get(s, 0) + times
    assert used == counts
    assert sum(n for _, n in plan) >= packing.lower_bound(counts, 64)


def fewest(sizes, capacity):
    """The fewest bins for a few sizes, by trying all ways to fill them one size after the other."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= sizes[k]:
                left = list(bins)
                left.remove(room)
                put(k + 1, [*left, room - sizes[k]])
        put(k + 1, [*bins, capacity - sizes[k]])

    put(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=11))
def test_packing_is_exact_without_a_limit(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    assert sum(n for _, n in packing.plan_sequences(counts, 20, None)) == fewest(sizes, 20)


@pytest.mark.parametrize("capacity", [100, 1000])
def test_packing_finds_planted_plans(capacity):
    for seed in range(8):
        r, sizes = random.Random(seed), []
        for _ in range(30):
            left = capacity
            while left:
                sizes.append(min(left, r.randint(capacity // 20, capacity // 2)))
                left -= sizes[-1]
        assert sum(n for _, n in packing.plan_sequences({s: sizes.count(s) for s in sizes}, capacity)) == 30
    assert sum(n for _, n in packing.plan_sequences({500: 1000, 300: 1000, 200: 1000, 131: 4000})) == 1500


@given(st.integers(5, 40), st.lists(st.integers(1, 12), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_fillings_are_all_undominated_ones(room, sizes):
    from itertools import product

    counts = {s: sizes.count(s) for s in sizes}
    names = sorted(counts)
    every = [f for f in product(*[range(counts[s] + 1) for s in names]) if sum(s * n for s, n in zip(names, f)) <= room]

    def dominated(f):
        left = room - sum(s * n for s, n in zip(names, f))
        for x, n, have in zip(names, f, (counts[s] for s in names)):
            if n < have:
                for part in product(*[range(k + 1) for k in f]):
                    gone = sum(s * k for s, k in zip(names, part))
                    alone = sum(part) == 1 and gone == x
                    if gone <= x <= gone + left and not alone:
                        return True
        return False

    want = sorted(sorted(s for s, n in zip(names, f) for _ in range(n)) for f in every if not dominated(f))
    assert sorted(sorted(f) for f in packing.fillings(room, counts, room, packing.Steps(None))) == want


def test_packing(spark):
    rows = corpus()
    placed = packing.pack_documents(frame(spark, rows), capacity=128)
    got = placed.collect()
    assert sum(r.length for r in got) == sum(len(x) + 1 for x in ENCODER.whole([t or "" for _, t in rows]))
    for s in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 128
    ids = {r.sequence_id: r.ids for r in packing.packed_ids(frame(spark, [r for r in rows if r[0] is not None]), placed.where("doc_id is not null")).collect()}
    for r in got:
        if r.doc_id == 905:
            assert len(ids[r.sequence_id]) <= 128
    assert packing.pack_documents(frame(spark, []), capacity=128).count() == 0


@pytest.mark.parametrize("crowd", [1, 16])
def test_jaccard(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "SHORT_LIST", crowd)
    monkeypatch.setattr(jaccard, "TILE", 3)
    rows = corpus(90, 5)
    sets, parent = {}, {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower() if not t or t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[k] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else ({tuple(w)} if w else set())
        parent[k] = k

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    keys = sorted(k for k in sets if k is not None)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert got == {k: (len(sets[k]), find(k) if k is not None else None) for k in sets}


def near_crowd(n):
    """Parts of a text, which head its lists as smallest sets but link with nothing, and copies of it all but for some words."""
    r = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(base[:150]), " ".join(base[50:])]
    for _ in range(n):
        own = list(base)
        for k in r.sample(range(200), r.randint(1, 4)):
            own[k] = f"x{r.randrange(100_000)}"
        texts.append(" ".join(own))
    return list(enumerate(texts))


def test_crowds_make_no_rows_by_pairs(spark, monkeypatch):
    """Two ids to a row are tables of pairs: of no group there may be as many as the square of its members."""
    monkeypatch.setattr(jaccard, "SHORT_LIST", 4)
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "SET_TILE", 16, raising=False)
    made, write = {}, Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if {"a", "b"} <= set(out.columns):
            made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    rows = near_crowd(150)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    words = {k: t.split() for k, t in rows}
    sets = {k: set(zip(w, w[1:], w[2:])) for k, w in words.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    least, before = {k: k for k in sets}, None
    while least != before:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert len(links) > 5 * len(rows) and len(set(least.values())) > 5
    assert max(made.values()) <= 4 * len(rows), sorted(made.items())


def test_embeddings(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((40, 64))
    v = np.concatenate((base, base + 0.2 * r.standard_normal((40, 64)), base[:5])).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(500, None), (501, []), (502, [0.0] * 64), (503, [float("nan")] * 64), (504, [None] * 64)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    for k in range(len(v)):
        assert got[k].n_links == near[k].sum() - 1
        assert got[k].component_id == np.flatnonzero(near[k]).min()
    assert all(got[k].n_links == 0 and got[k].kept for k in range(500, 505))


@pytest.mark.parametrize("d", [1, 2, 3, 5, 7, 8, 12, 16, 24, 32, 64, 384])
def test_pairs_at_the_cosine_share_a_cap(d):
    r = np.random.default_rng(d)
    a, b = r.standard_normal((2, 300, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if d > 1:
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    else:
        b = a
    code = embeddings.ProductCode(d)
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(code.decode(a), code.decode(b), strict=True)]) >= 0.96


def test_embeddings_of_many_dimensions(spark):
    r = np.random.default_rng(3)
    rows = [(100 * d + k, v.tolist()) for d in (3, 8, 16, 4102) for k, v in enumerate(np.repeat(r.standard_normal((5, d)), 2, axis=0) * np.array([[1.0], [1.1]] * 5))]
    rows += [(1, None), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in found if r.vec_id and r.vec_id > 1}
    assert all(got[k][1] <= k - k % 2 and got[k][0] >= 1 for k in got)
    assert all(got[100 * d + k] == (1, 100 * d + k - k % 2) for d in (16, 4102) for k in range(10))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_line_dedup(spark):
    a, b, c = "one two three four five six", "one two three four FIVE six", "one two four five six"
    rows = [(1, f"{a}\nshort line"), (2, f"{a}\n{b}\nshort line"), (3, f"  {c}  \nquite another line of some words"), (4, None), (5, ""), (None, "alone in a row of words")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got[1] == (f"{a}\nshort line", 2, 0, 0)
    assert got[2] == ("short line", 3, 1, 1)
    assert got[3] == ("quite another line of some words", 2, 0, 1)
    assert got[4] == (None, 0, 0, 0) and got[5] == ("", 1, 0, 0) and got[None][2:] == (0, 0)


def test_fm_index():
    r = np.random.default_rng(1)
    text = np.where(r.random(400) < 0.1, 0, r.integers(1, 4, 400))
    text[-1] = 0
    index = FMIndex(text, 3)
    for phrase in ([1], [1, 2], [3, 3, 1], [2, 1, 2, 1]):
        low, high = index.search(np.array([phrase]))
        want = [k for k in range(len(text)) if text[k : k + len(phrase)].tolist() == phrase]
        assert sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist()) == want


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, block):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "Two Words"), (3, None), (4, "..."), (None, "no id")]
    rows = [(1, "x Alpha, beta gamma delta epsilon zeta eta theta iota kappa! y"), (2, "two words two"), (3, None), (4, ""), (5, "no ids"), (None, "no id")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.find_overlap(frame(spark, rows), bench, block_bytes=block).collect()}
    assert {k: (r.n_words, r.n_hit, r.item_ids) for k, r in got.items()} == {
        1: (12, 10, ["1"]), 2: (3, 2, ["2"]), 3: (0, 0, []), 4: (0, 0, []), 5: (2, 0, []), None: (2, 2, [""]),
    }
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(frame(spark, rows), bench).collect()}
    assert cut[1] == "x ! y" and cut[2] == " two" and cut[5] == "no ids"
    assert decontamination.find_overlap(frame(spark, []), bench).count() == 0


def test_chat(spark):
    log = [(1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "Hel"), (1, 2, 4, "delta", None, "lo"),
           (1, 2, 5, "regenerate", None, "Well"), (1, 2, 6, "delta", None, "# <\\>"), (1, 1, 7, "edit", None, "hi!"), (1, 3, 8, "message", "tool: x", None), (1, 4, 9, "message", "user", "gone"), (1, 4, 10, "delete", None, None)]
    segments = chat.format_conversations(spark.createDataFrame(log, "conv_id long, message_id long, seq long, kind string, role string, text string"))
    texts = [("user", "hi!"), ("assistant", "Well# <\\>"), ("tool: x", "")]
    row = chat.read_back(segments).first()
    assert row.n_turns == 3 and row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in texts).encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(texts[1][1].encode()).hexdigest()
    assert chat.whole_texts(segments).first().formatted.startswith("### User: hi! </turn>\n### Assistant: Well\\# \\<\\\\> </turn>\n")


@given(st.text(), st.text())
@settings(max_examples=100, deadline=None)
def test_segments_read_back(role, text):
    escape = lambda t, more="": re.sub(rf"([\\#<{more}])", r"\\\1", t)
    assert chat.parse_segment(f"### ={escape(role, ':')}: {escape(text)} </turn>\n") == (role, text)


def test_html():
    page = "<title>no</title><p>Hi <b>there</b>you<p>Next<ul><li>a<li>b<ol><li>c</ol></ul><table><tr><td>1<td>two<tr><td>three<td>4</table><div hidden>no</div><script>no</script>end"
    assert html_text.visible_text(page) == "Hi thereyou\n\nNext\n\n- a\n- b\n  1. c\n\n1     | two\nthree | 4\n\nend"
    assert html_text.visible_text(None) == html_text.visible_text("") == html_text.visible_text("<div") == ""
    assert html_text.visible_text("<div>" * 5000 + "deep") == "deep"


def test_quality(spark):
    r = random.Random(4)
    clean = lambda: ". ".join(" ".join("".join(r.choices("abcdefg", k=4)) for _ in range(9)) for _ in range(6)) + "."
    junk = [lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "### "), lambda t: "spam " * 60, lambda t: t.replace(" ", " | ")]
    rows = [(k, clean() if k % 5 else junk[k // 5 % 4](clean())) for k in range(200)] + [(900, None), (901, ""), (902, "ok"), (None, clean())]
    got = {x.doc_id: x.rejected for x in quality.score_quality(frame(spark, rows)).collect()}
    assert {k for k, bad in got.items() if bad} == {k for k in range(200) if k % 5 == 0}
    assert quality.score_quality(frame(spark, [])).count() == 0


@pytest.mark.parametrize("d", [8, 64, 384])
def test_a_vector_stands_in_few_caps(d):
    a = np.random.default_rng(d).standard_normal((200, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert np.mean([len(x) for x in embeddings.ProductCode(d).decode(a)]) < 24


def test_groups_of_near_vectors_in_tiles(spark, monkeypatch):
    """Groups over several tiles, whose members link for the most part but not all, some of them more than once there."""
    monkeypatch.setattr(embeddings, "TILE", 64)
    r = np.random.default_rng(6)
    base = np.repeat(r.standard_normal((2, 32)), [250, 90], axis=0)
    v = np.concatenate((base + 0.33 * r.standard_normal(base.shape), base[:1], base[:1], base[:1])).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    got = {x.vec_id: x.n_links for x in embeddings.near_duplicates(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()}
    share = [got[k] / max(1, near[k].sum() - 1) for k in got]
    assert max(share) <= 1 and np.mean(share) > 0.985 and 0.2 < near[:250, :250].mean() < 0.98
