"""Queries over streams: a table arrives in two parts, the second after the stream has stopped and started again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wareloom.functions import dims
from wareloom.operators import asof, edits, records
from wareloom.plans.registry import query, table
from wareloom.scratch import fresh_path
from wareloom.streaming import keyed


def _in_parts(spark: SparkSession, rows: DataFrame, time: str, start: Callable[[DataFrame, str], StreamingQuery]) -> str:
    """Run ``start`` (of a stream and a folder for what it writes) over the first half of the time of ``rows``, then, from
    its checkpoint, over the other; gives the folder."""
    base = fresh_path(spark, "stream")
    span = rows.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    middle = span.select(((F.col("a") + F.col("b")) / 2).cast("long")).first()[0] or 0
    for k, half in enumerate((F.col(time) < middle, F.col(time) >= middle)):
        rows.where(half).write.parquet(f"{base}/in/part={k}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in/*")
        start(stream, base).awaitTermination()
    return base


_WAYS = "['A1', 'A2', 'B'][(event_id % 3 + 1)::int]"
#: One host in several refuses more than it answers, so that some are given up.
_ATTEMPTS = f"""a as (select user_id::varchar as host, event_id as id, epoch_us(ts) as ts, {_WAYS} as rung,
  case when event_id % 20 = 0 then 'clear' when event_type in ('error', 'signup') or (event_type = 'click' and user_id % 3 = 0) then 'refused' else 'answered' end as kind from events),
 s as (select *, count(*) filter (kind = 'clear') over w as seg from a window w as (partition by host order by ts, id)),
 i as (select *, count(*) filter (kind = 'answered') over (partition by host, seg order by ts, id) as island from s),
 k as (select *, case when kind = 'refused' then count(*) filter (kind = 'refused') over (partition by host, seg, island order by ts, id) else 0 end as streak from i),
 h as (select *, coalesce(max((streak >= {keyed.THRESHOLD})::int) over (partition by host, seg order by ts, id rows between unbounded preceding and 1 preceding), 0) = 1 as fast from k),
 v as (select *, case when kind = 'clear' then 'clear' when fast then 'fast_fail' else 'go' end as verdict, case when fast then {keyed.THRESHOLD} else streak end as now from h),
 g as (select host, id, n * {int(keyed.DELAY * 1e6)} + max(ts - n * {int(keyed.DELAY * 1e6)}) over (partition by host order by n) as starts_at
  from (select *, row_number() over (partition by host order by ts, id) - 1 as n from v where verdict = 'go')),
 o as (select v.host, v.id, v.ts, verdict, starts_at, now as streak, max(now) over (partition by v.host order by v.ts, v.id) as longest,
  nullif(last_value(case when verdict = 'clear' or (verdict = 'go' and kind = 'answered' and rung = 'A1') then '' when verdict = 'go' and kind = 'answered' then rung end ignore nulls)
   over (partition by v.host order by v.ts, v.id), '') as rung from v left join g on g.host = v.host and g.id = v.id)"""


def _asked(spark, sf_dir):
    kind = F.expr("case when event_id % 20 = 0 then 'clear' when event_type in ('error', 'signup') or (event_type = 'click' and user_id % 3 = 0) then 'refused' else 'answered' end")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind"),
        F.expr("element_at(array('A1', 'A2', 'B'), cast(event_id % 3 as int) + 1)").alias("rung"),
    )
    start = lambda stream, base: keyed.write_updates(keyed.ask_hosts(stream), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(keyed.HOSTS).parquet(f"{_in_parts(spark, rows, 'ts', start)}/out/batch=*")


@query(f"with {_ATTEMPTS} select host, id, verdict, starts_at::bigint as starts_at, streak::bigint as streak, longest::bigint as longest, rung from o")
def stream_hosts(spark, sf_dir):
    return _asked(spark, sf_dir).drop("ts")


@query(f"""with {_ATTEMPTS} select host, arg_max(streak, (ts, id))::bigint as streak, max(longest)::bigint as longest, arg_max(streak, (ts, id)) >= {keyed.THRESHOLD} as refusing,
 nullif(arg_max(coalesce(rung, ''), (ts, id)), '') as rung, (max(starts_at) + {int(keyed.DELAY * 1e6)})::bigint as next_allowed from o group by host""")
def stream_host_states(spark, sf_dir):
    return keyed.latest_of_hosts(_asked(spark, sf_dir))


@query("""with e as (select user_id || '-' || (event_id % 7) as key, event_id as id, ts, case event_type when 'error' then 'failed' when 'purchase' then case when event_id % 3 = 0 then 'done' else 'failed' end else 'request' end as kind from events),
 i as (select *, count(*) filter (kind = 'failed') over w as island, count(*) filter (kind = 'done') over w as dones from e window w as (partition by key order by ts, id)),
 n as (select *, row_number() over (partition by key, island order by ts, id) as nth from i where kind = 'request')
 select key, id, row_number() over (partition by key order by ts, id)::int as attempt from n where nth = 1 and dones = 0""")
def stream_retries(spark, sf_dir):
    kind = F.expr("case event_type when 'error' then 'failed' when 'purchase' then if(event_id % 3 = 0, 'done', 'failed') else 'request' end")
    rows = table(spark, sf_dir, "events").select(
        F.concat_ws("-", "user_id", F.col("event_id") % 7).alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind")
    )
    start = lambda stream, base: keyed.write_updates(keyed.let_through(stream), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(keyed.TRIES).parquet(f"{_in_parts(spark, rows, 'ts', start)}/out/batch=*")


# ---------------------------------------------------------------- caches valid at a time

_CACHES = {"find": (7, ("view",)), "rung": (30, ("purchase",)), "page": (0.5, ("click", "signup"))}


def _looked_up(spark: SparkSession, sf_dir: str, days: float, kinds: tuple[str, ...]) -> DataFrame:
    """Errors, each with what a cache of ``kinds`` of events, valid for ``days``, had for its user at the time."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    entries = events.where(F.col("event_type").isin(*kinds)).select("host", "ts", F.col("event_id").alias("entry_id"), "value")
    return asof.asof(events.where("event_type = 'error'").select("event_id", "host", "ts"), entries, ["host"], "ts", days * 86_400, order=["entry_id"])


@query(" union all ".join(f"""select '{name}' as cache, r.event_id, e.event_id as entry_id, e.value from (select * from events where event_type = 'error') r
 asof left join (select * from events where event_type in ({', '.join(f"'{k}'" for k in kinds)})) e on r.user_id = e.user_id and r.ts >= e.ts where e.event_id is null or r.ts - e.ts <= interval {round(days * 24)} hours
 union all select '{name}', r.event_id, null, null from (select * from events where event_type = 'error') r
 asof join (select * from events where event_type in ({', '.join(f"'{k}'" for k in kinds)})) e on r.user_id = e.user_id and r.ts >= e.ts where r.ts - e.ts > interval {round(days * 24)} hours""" for name, (days, kinds) in _CACHES.items()))  # fmt: skip
def cache_lookups(spark, sf_dir):
    found = [_looked_up(spark, sf_dir, days, kinds).select(F.lit(name).alias("cache"), "event_id", "entry.entry_id", "entry.value") for name, (days, kinds) in _CACHES.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""with e as (select c_custkey as k, c_nationkey % 5 as sha, c_acctbal as price, c_custkey % 4 as seq, timestamp '2024-01-01' + interval (c_custkey % 30) hours as at from customer),
 r as (select s_suppkey as id, s_nationkey % 5 as sha, timestamp '2024-01-01' + interval (s_suppkey % 50) hours as at from supplier),
 m as (select r.id, arg_max(e.k, (e.at, e.seq, e.k)) as entry from r join e on e.sha = r.sha and e.at <= r.at and r.at - e.at <= interval 12 hours group by r.id)
 select r.id, m.entry from r left join m on m.id = r.id""")
def cache_ties(spark, sf_dir):
    at = lambda k: F.expr(f"timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast({k} as int))")
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 5).alias("sha"), F.expr("c_custkey % 4 as seq"), at("c_custkey % 30").alias("at"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("sha"), at("s_suppkey % 50").alias("at"))
    return asof.asof(rows, entries, ["sha"], "at", 12 * 3600, order=["seq", "k"]).select("id", F.col("entry.k").alias("entry"))


# ---------------------------------------------------------------- edits

_LOG = """l as (select event_id, ts, user_id::varchar as row_key, ['title', 'sizes', 'price_inr'][(event_id % 3 + 1)::int] as field, event_type || event_id as value,
 case when event_type = 'error' then 'undo' when event_type = 'signup' and event_id % 5 = 0 then 'clear' when event_type = 'click' and event_id % 2 = 0 then 'undo' else 'set' end as kind from events)"""


def _log(spark, sf_dir):
    kind = "case when event_type = 'error' then 'undo' when event_type = 'signup' and event_id % 5 = 0 then 'clear' when event_type = 'click' and event_id % 2 = 0 then 'undo' else 'set' end"
    field = F.expr("element_at(array('title', 'sizes', 'price_inr'), cast(event_id % 3 as int) + 1)")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("row_key"), F.expr(kind).alias("kind"), field.alias("field"), F.concat("event_type", "event_id").alias("value")
    )


@query(" union all ".join(f"""select '{name}' as at, row_key, field, top.value as value, top.event_id as event_id from (select row_key, field,
 list_reduce(list({{'kind': kind, 'value': value, 'event_id': event_id}} order by ts, event_id),
  lambda stack, e: case when e.kind = 'set' then list_append(stack, e) when e.kind = 'clear' then stack[1:0] else stack[1:len(stack) - 1] end, list_filter(list({{'kind': kind, 'value': value, 'event_id': event_id}}), lambda x: false))[-1] as top
 from (with {_LOG} select * from l) where {where} group by 1, 2) where top is not null""" for name, where in (("end", "true"), ("january", "ts <= timestamp '2024-01-15'"))))  # fmt: skip
def edits_standing(spark, sf_dir):
    log = _log(spark, sf_dir)
    found = {"end": edits.standing(log), "january": edits.standing(log, F.lit("2024-01-15").cast("timestamp"))}
    out = [f.select(F.lit(name).alias("at"), "row_key", "field", "value", "event_id") for name, f in found.items()]
    return out[0].unionByName(out[1])


_ASKS = "select o_orderkey % 40 as request_id, (o_custkey + case when o_orderkey % 10 = 0 then 100000000 else 0 end)::varchar as row_key, {field} as field, {value} as value from orders"
_FIELD = {"sql": "['category_slug', 'subcategory_slug', 'hs_code'][(o_orderkey % 3 + 1)::int]", "spark": "element_at(array('category_slug', 'subcategory_slug', 'hs_code'), cast(o_orderkey % 3 as int) + 1)"}
_VALUE = "case o_orderkey % 9 when 0 then 'apparel' when 3 then 'jewellery' when 6 then 'nope' when 1 then 'rings' when 4 then 'kids' when 7 then '' when 2 then '6206' when 5 then ' 7113 ' else 'x' end"
_OWN = "case c_nationkey % 3 when 0 then 'apparel' when 1 then 'jewellery' end"


@query(f"""with a as (select request_id, row_key, field, max(value) as value from ({_ASKS.format(field=_FIELD['sql'], value=_VALUE)}) group by 1, 2, 3),
 r as (select c_custkey::varchar as row_key, {_OWN} as own from customer),
 c as (select request_id, row_key, value as chosen from a where field = 'category_slug'),
 f as (select a.*, coalesce(c.chosen, r.own) as category, case when r.row_key is null then 'no_such_row' when trim(a.value) = '' then null
   when field = 'category_slug' and value not in ({', '.join(f"'{c}'" for c in dims.CATEGORIES)}) then 'unknown_category'
   when field = 'subcategory_slug' and coalesce(coalesce(c.chosen, r.own), '') || '/' || value not in ({', '.join(f"'{s}'" for s in dims.SHELVES)}) then 'unknown_subcategory'
   when field = 'hs_code' and not regexp_matches(trim(value), '^[0-9]{{4,10}}$') then 'bad_hs_code' end as own_fault
  from a left join r on r.row_key = a.row_key left join c on c.request_id = a.request_id and c.row_key = a.row_key)
 select request_id, row_key, field, value, first_value(own_fault ignore nulls) over (partition by request_id, row_key order by list_position({list(records.CELLS)}, field) rows between unbounded preceding and unbounded following) as fault from f""")
def bulk_edits(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_OWN).alias("category_slug"))
    asks = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 40 as request_id", "cast(o_custkey + if(o_orderkey % 10 = 0, 100000000, 0) as string) as row_key", f"{_FIELD['spark']} as field", f"{_VALUE} as value")
    return edits.judged(own, spark.createDataFrame([], edits.EVENTS), asks, "c_custkey")
