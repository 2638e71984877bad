"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

The edit bound is one word: two lines are near duplicates if one becomes the other by inserting, deleting or replacing
one word. A line's variants are the line itself and every line with one word left out; two lines within the bound
share a variant, at the same place for a replacement. Variants are hashed, equal ones joined, and the words compared.

Two steps keep the join small. Equal lines become one first (by two 64-bit hashes and the number of words). Then only
lines that could be within the bound of another emit their variants: an edit leaves the line's first or second half
as it was, so such lines share the hash of a half.

For the variants any white space parts words. Lines of few words have exact copies only: with one word of a short line
replaced, little of it is left that is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wareloom.llm.common import Scratch, quoted, with_own_names

#: Lines of fewer words have no near copies; whether their exact copies go is up to the caller (``short_copies``).
LEAST_WORDS = 5
#: Document numbers that may be broadcast.
BROADCAST_IDS = 1_000_000
#: White space, all of which parts words; a line end of two characters leaves its \r in the line.
_SPACES = " \t\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _lines(docs: DataFrame, least_words: int, short_copies: bool) -> DataFrame:
    """doc_id, line_no, line (trimmed, words parted by blanks), w (its words), h1, h2 (of the line as it stands, trimmed)
    of the lines that take part."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).withColumn("raw", F.trim("raw"))
    split = split.withColumn("line", F.trim(F.translate("raw", _SPACES, " " * len(_SPACES)))).where("line <> ''")
    # as many words as there are blanks between them, and one
    split = split.withColumn("w", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    split = split if short_copies else split.where(F.col("w") >= least_words)
    return split.select("doc_id", "line_no", "line", "w", F.xxhash64("raw").alias("h1"), F.xxhash64(F.lit(7), "raw").alias("h2"))


def _same_place(a: DataFrame, b: DataFrame, own: list[str], how: str = "inner") -> DataFrame:
    """``a`` and ``b`` joined on doc_id (a null one equals a null one), line_no and ``own``; with ``a``'s of these."""
    b = b.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "line_no", *own)])
    on = a["doc_id"].eqNullSafe(b["_doc_id"])
    for c in ("line_no", *own):
        on = on & (a[c] == b[f"_{c}"])
    return a.join(b, on, how).select(*a.columns)


def _halves() -> Column:
    """Hashes of the line's beginnings and ends that lines within one edit have in common."""
    w = F.col("w")
    size = lambda n: F.floor(n / 2).cast("int")
    keys = [
        F.xxhash64(F.lit(side), n, F.call_function("substring_index", F.col("line"), F.lit(" "), n if side == 1 else -n))
        for side, n in ((1, size(w)), (1, size(w - 1)), (2, w - size(w)), (2, w - 1 - size(w - 1)))
    ]
    return F.array_distinct(F.array(*keys))


def _variants() -> Column:
    """(place, key): 0 and the whole line, then each place and the line without its word there."""
    before = lambda i: F.call_function("substring_index", F.col("line"), F.lit(" "), i - 1)
    after = lambda i: F.call_function("substring_index", F.col("line"), F.lit(" "), i - F.col("w"))
    whole = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64("line").alias("key")))
    less = F.transform(
        F.sequence(F.lit(1), F.col("w")),
        lambda i: F.struct(i.alias("place"), F.xxhash64(F.trim(F.concat(before(i), F.lit(" "), after(i)))).alias("key")),
    )
    return F.concat(whole, less)


def within_one_word(a: str, b: str) -> Column:
    """Whether the word arrays named ``a`` and ``b`` are at an edit distance of at most one word."""
    longer = F.greatest(F.size(a), F.size(b))
    shared = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, same: F.struct((acc["n"] + (acc["on"] & same).cast("int")).alias("n"), (acc["on"] & same).alias("on")),
    )["n"]
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (
        shared(F.col(a), F.col(b)) + shared(F.reverse(a), F.reverse(b)) >= longer - 1
    )


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS, short_copies: bool = False) -> DataFrame:
    """(doc_id, line_no, near) of the lines of ``docs`` (doc_id, text) that go: near tells a near from an exact copy.

    Lines are what stands between line ends, trimmed of blanks; those of white space alone never go. A line goes if an
    equal line stands earlier, or if its first occurrence has an earlier line within one word; earlier is by doc_id
    (null first), then line number. Lines of fewer than ``least_words`` words (by single characters of white space) have
    no near copies; with ``short_copies`` their exact copies go like any others, without it these lines are left alone. Whether that earlier line goes itself
    doesn't matter, so the earliest of a chain stays. Null and empty texts have no lines that take part. Repeated
    rows of one doc_id count as one document: their lines share a place and aren't copies of each other.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    own = ["h1", "h2", "w"]
    place = F.struct("doc_id", "line_no")
    lines = _lines(docs, least_words, short_copies)
    halves = F.when(F.col("w") >= least_words, _halves())
    every = scratch.write(lines.select("doc_id", "line_no", *own, halves.alias("halves")), "lines")
    first = every.groupBy(*own).agg(F.min(place).alias("at"), F.count("*").alias("times"), F.first("halves").alias("halves"))
    first = scratch.write(first, "distinct")

    # lines that share a half with another line
    long = F.col("w") >= least_words
    halves = first.where(long).select(*own, F.explode("halves").alias("half"))
    alike = Window.partitionBy("half")
    line = F.struct(*own)
    near = halves.withColumn("x", F.min(line).over(alike)).withColumn("y", F.max(line).over(alike)).where("x <> y")
    near = scratch.write(near.select(*own).distinct().join(first, own).select("at.*", *own), "near-places")
    # their words: of the documents that they stand in, if these are few enough to be told to all, else of all
    ids = near.select(F.col("doc_id").alias("_id")).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        lines = _lines(docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), least_words, short_copies)
    near = scratch.write(_same_place(lines.where(long), near, own).dropDuplicates(own), "near")

    # each variant's group: lines with one word replaced at a place, and the line that all of them extend
    parts = near.select("doc_id", "line_no", "h1", "h2", "w", F.inline(_variants()))
    parts = parts.withColumn("at", F.struct("doc_id", "line_no", "h1", "h2", "w"))
    # by size too: the whole line has as many words as the others have left
    parts = parts.withColumn("left", F.when(F.col("place") == 0, F.col("w")).otherwise(F.col("w") - 1))
    # one exchange and one order for both kinds of group
    parts = parts.repartition("key", "left")
    replaced = Window.partitionBy("key", "left", "place")
    extended = Window.partitionBy("key", "left")
    parts = parts.withColumn("first", F.min("at").over(replaced))
    parts = parts.withColumn("whole", F.min(F.when(F.col("place") == 0, F.col("at"))).over(extended))
    parts = parts.withColumn("longer", F.min(F.when(F.col("place") > 0, F.col("at"))).over(extended))
    earlier = F.array_compact(F.array(F.when(F.col("place") > 0, F.col("first")), F.when(F.col("place") > 0, F.col("whole")), F.when(F.col("place") == 0, F.col("longer"))))
    pairs = parts.select("at", F.explode(F.filter(earlier, lambda e: e < F.col("at"))).alias("to")).distinct()
    words = near.select(F.struct("doc_id", "line_no", "h1", "h2", "w").alias("at"), F.split("line", " ", -1).alias("own"))
    # by hashes, as the place may have a null doc_id
    by = lambda at, text: words.select(*[F.col(f"at.{c}").alias(f"{at}_{c}") for c in own], F.col("own").alias(text))
    pairs = pairs.select("at", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("at", "to") for c in own])
    pairs = pairs.join(by("at", "own"), [f"at_{c}" for c in own]).join(by("to", "other"), [f"to_{c}" for c in own])
    gone = scratch.write(pairs.where(within_one_word("own", "other")).select("at.h1", "at.h2", "at.w").distinct(), "gone")

    marked = first.join(gone.withColumn("near", F.lit(True)), own, "left").where("times > 1 or near")
    marked = marked.select(*own, "at", F.coalesce("near", F.lit(False)).alias("near"))
    out = every.select("doc_id", "line_no", *own).join(marked, own).withColumn("is_first", F.expr("struct(doc_id, line_no) <=> at"))
    return out.where("near or not is_first").select("doc_id", "line_no", (F.col("near") & F.col("is_first")).alias("near")).distinct()


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, short_copies: bool = False) -> DataFrame:
    """``docs`` with the lines of ``repeated_lines`` taken out of ``text``, and n_lines, n_exact, n_near (all long).

    Needs doc_id and text; other columns pass through, and columns named like the three counts are replaced. A null
    text stays null with 0 lines. Which lines go is kept in words of 64 bits, so a text of many lines, all of which
    go, takes no search per line.
    """
    docs = docs.drop("n_lines", "n_exact", "n_near")
    plain, _ = with_own_names(docs, ("_key", "_words", "n_exact", "n_near"))
    word = F.floor(F.col("line_no") / 64).cast("int").alias("word")
    gone = repeated_lines(docs, least_words, short_copies).groupBy(F.col("doc_id").alias("_key"), word).agg(
        F.expr("bit_or(shiftleft(1L, line_no % 64))").alias("bits"), F.count_if(~F.col("near")).alias("n_exact"), F.count_if("near").alias("n_near")
    )
    gone = gone.groupBy("_key").agg(F.collect_list(F.struct("word", "bits")).alias("_words"), *[F.sum(c).alias(c) for c in ("n_exact", "n_near")])
    # a word for each 64 lines up to the last that goes; made below the join, so that it's made once for a document
    dense = "transform(sequence(0, array_max(transform(_words, x -> x.word))), w -> coalesce(get(filter(_words, x -> x.word = w), 0).bits, 0L))"
    joined = plain.join(gone.withColumn("_words", F.expr(dense)), F.col("doc_id").eqNullSafe(F.col("_key")), "left")
    kept = "array_join(filter(split(text, '\\n', -1), (x, i) -> (shiftright(coalesce(get(_words, i div 64), 0L), i % 64) & 1) = 0), '\\n')"
    cut = F.when(F.col("_words").isNull(), F.col("text")).otherwise(F.expr(kept))
    counts = (
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
    columns = [(cut if c == "text" else quoted(n)).alias(c) for n, c in zip(plain.columns, docs.columns, strict=True)]
    return joined.select(*columns, *counts)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, whatever their names, and repeated and nearly repeated lines (of any number of words
    for exact copies) gone, but for the earliest. A document that loses all its words goes; n_chars, if there is one,
    follows a text that changed. See ``repeated_lines`` for nulls, ties and repeated rows."""
    plain, back = with_own_names(docs, ("n_lines", "n_exact", "n_near"))
    out = dedup_lines(plain, short_copies=True)
    changed = F.col("n_exact") + F.col("n_near") > 0
    out = out.where(~changed | F.col("text").rlike(f"[^{_SPACES}\n]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return back(out)
