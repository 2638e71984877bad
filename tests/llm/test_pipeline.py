import random

import pytest

import corpus_pipeline
from wareloom.llm import jaccard, line_dedup, quality

COLUMNS = "doc_id long, text string, N_Words string, _key int, _words int, n_lines int, n_exact string, quality double, rejected boolean, pattern string, h int, `a.b` int, n_hit int, item_ids int, low int, bits int"
EXTRA = ("clash", 7, 8, 9, "e", 0.25, True, "p", 1, 2, 3, None, None, 5)


def prose(seed, words=60):
    r = random.Random(seed)
    return ". ".join(" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(10)) for _ in range(words // 10)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('pipeline')}"
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, None), (None, "")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows():
    near = prose(5).split(" ")
    near[30] = "changed"
    hit = prose(6) + "\nSo alpha beta gamma delta epsilon zeta eta theta iota kappa lambda it ends."
    out = [(1, prose(1)), (1, prose(1)), (2, None), (3, ""), (4, prose(5)), (5, " ".join(near)), (6, hit), (None, prose(7)), (7, prose(8) + "\n" + prose(1)), (8, "x" * 200_000)]
    return [(k, t, *EXTRA) for k, t in out]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_odd_columns_and_take_empty_tables(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(rows(), COLUMNS)
    out = stage(spark, docs, folder)
    got = out.collect()
    assert out.columns == docs.columns and all(tuple(r)[2:] == EXTRA for r in got)
    ids = sorted((r[0] is not None, r[0] or 0) for r in got)
    want = {"quality": [None, 1, 1, 2, 3, 4, 5, 6, 7, 8], "line_dedup": [None, 1, 1, 2, 3, 4, 6, 7, 8], "near_duplicates": [None, 1, 2, 3, 4, 6, 7, 8], "decontamination": [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]}
    keep = {1, 2, 3, 4, 5, 6, 7, None} if name == "quality" else {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert [k for k in ((k if there else None) for there, k in ids) if k in keep] == [k for k in want[name] if k in keep]
    texts = {r[0]: r[1] for r in got}
    assert texts[2] is None and texts[3] == ""
    if name == "line_dedup":
        assert texts[7] == prose(8)
    if name == "decontamination":
        assert texts[6].endswith("\nSo  it ends.") and texts[8] == "x" * 200_000
    empty = stage(spark, docs.limit(0), folder)
    assert empty.columns == docs.columns and empty.count() == 0


def test_n_chars_follows(spark, folder):
    line = prose(3)
    docs = spark.createDataFrame([(1, f"{line}\n{prose(4)}", 999), (2, f"own words here\n{line}", 999)], "doc_id long, text string, n_chars int")
    out = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, folder).collect()}
    assert (out[1].n_chars, out[2].text, out[2].n_chars) == (999, "own words here", 14)


def test_pack_takes_nulls(spark, folder):
    got = corpus_pipeline.pack(spark, spark.createDataFrame(rows(), COLUMNS), folder).collect()
    assert sorted({r.doc_id for r in got if r.doc_id is not None}) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [r.length for r in got if r.doc_id == 2] == [1]


def test_run(spark, folder):
    docs = spark.createDataFrame([r[:2] for r in rows()], "doc_id long, text string")
    docs.write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    left = {r.doc_id for r in got}
    assert {1, 2, 3, 4, 6, 7, None} <= left and 5 not in left and len([r for r in got if r.doc_id == 1]) == 1


def test_lines_of_long_texts(spark):
    text = "\n".join(["the same line of words again"] * 5_000 + ["own words to stay here"])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), short_copies=True).collect()}
    assert got[1].text == "the same line of words again\nown words to stay here" and (got[1].n_lines, got[1].n_exact) == (5001, 4999)
    assert got[2].text == "" and got[2].n_exact == 5001


def test_repeated_rows_of_one_document(spark):
    a, b = prose(1), prose(2)
    got = jaccard.keep_one(spark.createDataFrame([(1, a, "x"), (1, a, "y"), (1, b, "z"), (2, a, "v"), (3, b, "w")], "doc_id long, text string, other string")).collect()
    assert sorted((r.doc_id, r.text == a) for r in got) == [(1, False), (1, True)]


def test_scores_of_rows_that_share_a_number(spark):
    out = quality.score_quality(spark.createDataFrame([(1, prose(k) if k % 3 else "### $$$ @@@ !!! " * 20) for k in range(60)], "doc_id long, text string")).collect()
    assert all(r.rejected == r.text.startswith("###") for r in out)
