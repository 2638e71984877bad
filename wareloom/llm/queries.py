"""Queries op1 to op10 over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.llm import (
    chat,
    decontamination,
    embeddings,
    html_text,
    jaccard,
    language_id,
    line_dedup,
    packing,
    quality,
    runs,
    sharding,
    token_store,
    whitening,
)
from wareloom.llm.common import Scratch, table

#: What the extra conversation of op1 says, twice.
PROBE = r"\### Assistant: </turn> ok"
#: Shards of op12.
SHARDS = 16


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return chat.read_back(chat.format_conversations(chat.turn_events(turns.unionByName(probe))))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select(
        "page_id", "text", F.char_length("text").cast("long").alias("n_chars"),
        F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short_copies=True)
    return docs.select("doc_id", "n_lines", "n_exact", "n_near", F.md5("text").alias("text_md5"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "quality", "rejected", (~F.col("rejected")).alias("kept"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-store").path("store")
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.predict(docs, language_id.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_overlap(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "shards").path("shards")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sharding.write_shards(docs, path, SHARDS)
    stored = sharding.read_shards(spark, path, docs.schema)
    grown = sharding.grown_shard(F.col("doc_id"), F.col("shard"), SHARDS, {SHARDS: 1.0})
    return stored.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", grown.alias("grown_shard"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), change=runs.folded)
    return runs.digests(found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_html_extraction,
        op3_line_dedup,
        op4_best_fit_packing,
        op5_quality_classifier,
        op6_ngram_jaccard_join,
        op7_embedding_near_dedup,
        op8_token_id_output,
        op9_language_id,
        op10_benchmark_decontamination,
        op11_embedding_whitening,
        op12_sharding,
        op13_periodic_runs,
    )
}
#: The SQL is for small tables: it compares all sets that share a shingle, and counts bytes one by one.
#: A shard's score for a key, in SQL: what ``sharding.best_shard`` says.
_SCORE = f"ln((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || k), 1, 13) as bigint) + 0.5) / {2.0**sharding.BITS})"
SQL: dict[str, str] = {
    "op1_chat_format": rf"""
with t as (
  select conv_id, turn, role, coalesce(text, '') as text, row_number() over (partition by conv_id, turn order by role nulls first, text nulls first) as twin from (
    select conv_id, turn, role, text from conversations
    union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}')),
r as (
  select conv_id, coalesce(turn, -1) as turn, turn is not null as known, twin, coalesce(role, '') as role, text, role = 'assistant' as learned,
    '### ' || case role when 'user' then 'User' when 'assistant' then 'Assistant' when 'system' then 'System' else '=' || regexp_replace(coalesce(role, ''), '([\\#<:])', '\\\1', 'g') end
      || ': ' || regexp_replace(text, '([\\#<])', '\\\1', 'g') || ' </turn>' || chr(10) as segment
  from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by known, turn, twin)) as turns_sha256,
  coalesce(sum(length(text)) filter (learned), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by known, turn, twin) filter (learned), '')) as loss_sha256,
  sum(length(segment))::bigint as formatted_chars
from r group by conv_id""",
    "op6_ngram_jaccard_join": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) end) as s from d),
-- texts with one set are one class
c as (select min(doc_id) as rep, list(doc_id) as members, s, len(s) as n from (select doc_id, list_sort(s) as s from s) where len(s) > 0 group by s),
x as (select rep, n, unnest(s) as shingle from c),
p as (select a.rep as a, b.rep as b from x a join x b on a.shingle = b.shingle and a.rep < b.rep and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
reach(a, b) as (select rep, rep from c union select r.a, e.b from reach r join e on r.b = e.a),
g as (select a, min(b) as component from reach group by a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(g.component, s.doc_id) as component_id
from s left join (select unnest(members) as doc_id, rep from c) m on m.doc_id = s.doc_id left join g on g.a = m.rep""",
    "op10_benchmark_decontamination": r"""
with i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
v as (
  select distinct item_id, least(len(w), 10) as size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: w[k : k + 9])) as piece from i where len(w) > 0),
d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
o as (
  select doc_id, size, k, w[k : k + size - 1] as piece from (
    select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from d, (select distinct size from v) where len(w) >= size)),
h as (select o.doc_id, o.k, o.size, v.item_id from o join v on v.size = o.size and v.piece = o.piece),
n as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(k, k + size)) as k from h) group by doc_id),
m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join m using (doc_id)""",
    "op12_sharding": f"""
with halves as (
  -- what four shifts of CRC-32 make of each half byte
  select list(x order by i) as t from (
    select i, list_reduce(range(0, 4), lambda acc, k: case when acc & 1 = 1 then xor(acc >> 1, 3988292384) else acc >> 1 end, i) as x
    from range(16) r(i))),
docs as (
  select doc_id, text, octet_length(encode(coalesce(text, ''))) as n,
    list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda c: cast(instr('0123456789ABCDEF', c) as bigint) - 1) as h
  from documents),
sized as (
  select doc_id, cast(n + 1 as bigint) as size, text is null as absent,
    case when n = 0 then 0 else xor(4294967295, list_reduce(range(0, 2 * n),
      lambda acc, k: xor(acc >> 4, t[(xor(acc, h[(case when k % 2 = 0 then k + 2 else k end)]) & 15) + 1]), 4294967295)) end as text_crc32
  from docs, halves),
placed as (
  select doc_id, size, absent, text_crc32,
    cast((select arg_max(k, ({_SCORE}, -k)) from range({SHARDS}) r(k)) as integer) as shard,
    cast((select arg_max(k, ({_SCORE}, -k)) from range({SHARDS + 1}) r(k)) as integer) as grown_shard
  from sized)
select doc_id, size, cast(text_crc32 as bigint) as text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by doc_id nulls first, not absent, text_crc32, size) - 1 as slot, grown_shard
from placed""",
}
