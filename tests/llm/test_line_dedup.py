from wareloom.llm import line_dedup

DOCS = "doc_id long, text string"


def kept(spark, rows, **how):
    return {r.doc_id: (r.text, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), **how).collect()}


def test_exact_copies_of_short_lines_go(spark):
    chinese, token = "沒有空白的一行很長的文字" * 9, "x" * 5000
    rows = [(1, f"All rights reserved.\n\n{chinese}\n{token}\na\tb"), (2, f"own\n  All rights reserved. \n\n{chinese}\n{token}\na\tb\n\t\nAll rights gone."), (3, "\t\nown")]
    got = kept(spark, rows, short_copies=True)
    assert got[1] == (rows[0][1], 0, 0)
    assert got[2] == ("own\n\n\t\nAll rights gone.", 4, 0) and got[3] == ("\t", 1, 0)


def test_near_copies_by_any_white_space(spark):
    got = kept(spark, [(1, "one\ttwo\tthree\tfour\tfive"), (2, "one\ttwo\tthree\tfour\tFIVE\nrest"), (3, "one two three　four five six\r\nrest too")], short_copies=True)
    assert got[1][1:] == (0, 0) and got[2] == ("rest", 0, 1) and got[3] == ("rest too", 0, 1)


def test_lines_of_a_row_without_id_come_first(spark):
    rows = [(1, "one two three four FIVE\nrest"), (None, "one two three four five"), (2, "one two three four five")]
    for short in (False, True):
        got = kept(spark, rows, short_copies=short)
        assert got == {None: ("one two three four five", 0, 0), 1: ("rest", 0, 1), 2: ("", 1, 0)}
