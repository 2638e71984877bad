"""Terms of a table found in texts, all in one pass over each text.

Terms are rows, not expressions: an Aho-Corasick automaton over them is built once per worker and run over each text in
Arrow batches, so plans don't grow with the vocabulary, nor does the time per character. Terms reach the driver in chunks
of a bounded size and are broadcast so; a table beyond one chunk takes one more pass over the texts per chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wareloom.functions import dims

#: Characters of the terms and what goes with them in one broadcast, at most.
CHUNK_CHARS = 32_000_000
#: What a term's row has: the list and entry it speaks for, the term, whether a plural of it counts, its place in the
#: entry, and a code.
TERMS = "list string, slug string, term string, plural boolean, rank int, code string"
CODES = "slug string, code string"
#: Automata that a worker keeps, by chunk; a few at most.
_HELD: dict[str, tuple] = {}
MOST_HELD = 4


def default_terms(spark: SparkSession) -> DataFrame:
    """The vocabularies that come with the package, as a table of terms."""
    rows = []
    for name, entries, plural in (("category", dims.CATEGORIES, True), ("shelf", dims.SHELVES, True), ("policy", dims.POLICY, False)):
        rows += [(name, slug, t, plural, k, None) for slug, words in entries.items() for k, t in enumerate(words)]
    rows += [("material", slug, t, False, k, code) for slug, codes in dims.HS_BY_MATERIAL.items() for k, (t, code) in enumerate(codes.items())]
    return spark.createDataFrame(rows, TERMS)


def default_codes(spark: SparkSession) -> DataFrame:
    """Tariff codes of shelves (category/shelf) and categories."""
    return spark.createDataFrame([*dims.HS_BY_SHELF.items(), *dims.HS_BY_CATEGORY.items()], CODES)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms from delimited files with a header (list, slug, term; plural, rank and code may be absent) or Parquet, checked."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    wanted = StructType.fromDDL(TERMS)
    if unknown := sorted({c.lower() for c in raw.columns} - set(wanted.names)):
        raise ValueError(f"unknown columns of terms: {', '.join(unknown)}")
    if missing := [c for c in ("list", "slug", "term") if c not in raw.columns]:
        raise ValueError(f"terms without {', '.join(missing)}")
    defaults = {"plural": F.lit(False), "rank": F.lit(0), "code": F.lit(None)}
    return checked(raw.select(*[(F.col(f.name) if f.name in raw.columns else defaults[f.name]).cast(f.dataType).alias(f.name) for f in wanted.fields]))


def faults(terms: DataFrame) -> DataFrame:
    """(list, slug, term, fault) of the rows that a table of terms must not have: empty cells, and a term twice in an entry."""
    clean = terms.select("list", "slug", F.lower(F.trim("term")).alias("term"))
    empty = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"no {c}") for c in ("list", "slug", "term")]
    twice = clean.groupBy("list", "slug", "term").agg(F.count("*").alias("n")).select("*", F.coalesce(*empty, F.when(F.col("n") > 1, "twice")).alias("fault"))
    return twice.where("fault is not null").select("list", "slug", "term", "fault")


def checked(terms: DataFrame) -> DataFrame:
    """``terms`` with trimmed terms in lower case; the first few faults are an error."""
    if wrong := faults(terms).orderBy("list", "slug", "term").limit(5).collect():
        raise ValueError("; ".join(f"{r['fault']}: {r['list']}, {r['slug']}, {r['term']}" for r in wrong))
    return terms.withColumn("term", F.lower(F.trim("term")))


def _chunks(terms: DataFrame, size: int) -> Iterator[list[tuple]]:
    """The terms' rows in order, a chunk at a time on the driver."""
    chunk, chars = [], 0
    for row in terms.orderBy("list", "slug", "rank", "term").toLocalIterator():
        chunk.append(tuple(row))
        chars += sum(len(x) for x in row if isinstance(x, str)) + 40
        if chars >= size:
            yield chunk
            chunk, chars = [], 0
    if chunk:
        yield chunk


def _folded(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def hits(automaton, entries: list[list[tuple[int, bool]]], text: str) -> set[int]:
    """Numbers of the terms that stand in a text as whole words, with an s or es behind them where a plural counts."""
    text, found = _folded(text), set()
    n = len(text)
    for last, (size, group) in automaton.iter(text):
        begin, end = last + 1 - size, last + 1
        if begin and _in_word(text[begin - 1]):
            continue
        alone = end == n or not _in_word(text[end])
        plural = alone or any(text.startswith(s, end) and (end + len(s) == n or not _in_word(text[end + len(s)])) for s in ("s", "es"))
        if plural:
            found.update(k for k, also_plural in entries[group] if alone or also_plural)
    return found


def _automaton(rows: list[tuple]):
    """The automaton of a chunk's terms, and what each distinct term stands for: (row, whether a plural counts)."""
    import ahocorasick

    groups: dict[str, list[tuple[int, bool]]] = {}
    for k, row in enumerate(rows):
        if row[2]:
            groups.setdefault(_folded(row[2]), []).append((k, bool(row[3])))
    automaton = ahocorasick.Automaton()
    for g, term in enumerate(groups):
        automaton.add_word(term, (len(term), g))
    automaton.make_automaton()
    return automaton, list(groups.values())


def find_terms(rows: DataFrame, fields: Mapping[str, Column], terms: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``rows`` with found: array of struct(list, slug, term, rank, code, field), each term once for each of ``fields``
    (texts by name) that it stands in, in the order of list, slug, rank, term.

    A term stands in a text if it does so without regard to case and with no letter, digit or underscore on either side;
    with plural, s or es may follow it. Null texts and null or empty terms match nothing. Columns called found, or like
    ``_text_`` and a field's name, are replaced. Rows aren't moved.
    """
    spark = rows.sparkSession
    kinds = StructType.fromDDL(TERMS)
    own = [c for c in rows.columns if c != "found"]
    inputs = {f"_text_{name}": name for name in fields}
    own = [c for c in own if c not in inputs]
    out = rows.select(*own, *[fields[name].cast("string").alias(c) for c, name in inputs.items()])
    carried = [f for f in kinds.fields if f.name != "plural"]
    item = StructType([*carried, StructField("field", StringType())])
    parts = []
    for chunk in _chunks(terms.select(*kinds.names), chunk_chars):
        held, chunk_name = spark.sparkContext.broadcast(chunk), uuid.uuid4().hex
        part = f"_found_{len(parts)}"
        schema = StructType.fromDDL(f"{part} array<{item.simpleString()}>")
        schema = StructType([*out.schema.fields, *schema.fields])

        def search(batches: Iterator, held=held, chunk_id=chunk_name, schema=schema) -> Iterator:
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema

            if chunk_id not in _HELD:
                if len(_HELD) >= MOST_HELD:
                    _HELD.clear()
                _HELD[chunk_id] = (held.value, *_automaton(held.value))
            entries, automaton, groups = _HELD[chunk_id]
            shape = to_arrow_schema(schema)
            columns = [pa.array([row[kinds.names.index(f.name)] for row in entries], to_arrow_schema(StructType([f]))[0].type) for f in carried]
            for batch in batches:
                texts = {name: batch.column(c).to_pylist() for c, name in inputs.items()}
                bounds, places, names = [0], [], []
                for k in range(batch.num_rows):
                    pairs = sorted((e, i) for i, name in enumerate(texts) if texts[name][k] and len(automaton) for e in hits(automaton, groups, texts[name][k]))
                    places += [e for e, _ in pairs]
                    names += [list(texts)[i] for _, i in pairs]
                    bounds.append(len(places))
                at = pa.array(places, pa.int64())
                kind = shape[-1].type
                values = pa.StructArray.from_arrays([*[c.take(at) for c in columns], pa.array(names, pa.string())], fields=list(kind.value_type))
                found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, type=kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, found], schema=shape)

        out = out.mapInArrow(search, schema)
        parts.append(part)
    none = F.array().cast(f"array<{item.simpleString()}>")
    return out.select(*own, (F.concat(*parts) if parts else none).alias("found"))
