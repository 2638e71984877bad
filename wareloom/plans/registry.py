"""Registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wareloom.functions import dims, texts, urls, values
from wareloom.operators import enrich, gates, images, ledger, review, vocabulary
from wareloom.scratch import fresh_path
from wareloom.sources import exports, links
from wareloom.streaming import outcomes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over all cores by their key: short rows from which long texts are made, so that their few splits don't make
    all of these, nor the texts themselves move."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


# ---------------------------------------------------------------- links and plans

_TRACKING = "|".join(urls.TRACKING)
#: The pages' links have plain query parts, a scheme and no user or port.
CANONICAL = rf"""
 with p as (select page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) s, lower(regexp_extract(url, '://([^/?#]*)', 1)) h,
   regexp_extract(url, '://[^/?#]*([^?#]*)', 1) path, regexp_extract(url, '\?([^#]*)', 1) q from pages),
 c as (select page_id, url, s || '://' || case when h like 'www.%' and length(h) - length(replace(h, '.', '')) > 1 then substr(h, 5) else h end
   || case when path = '' then '/' else path end as base,
   array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' and not regexp_full_match(lower(string_split(x, '=')[1]), '{_TRACKING}')), '&') as kept from p),
 canon as (select page_id, url, base || case when coalesce(kept, '') = '' then '' else '?' || kept end as canonical,
   lower(regexp_extract(base, '://([^/?#]*)', 1)) as host from c)
"""


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.canonical(F.col("url")).alias("canonical"))


@query(f"{CANONICAL} select page_id, canonical, host from canon")
def url_canonical(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "canonical", urls.host(F.col("canonical")).alias("host"))


@query(f"{CANONICAL} select host, count(*)::bigint as links, count(distinct canonical)::bigint as products from canon group by host")
def url_host_counts(spark, sf_dir):
    named = _pages(spark, sf_dir).withColumn("host", urls.host(F.col("canonical")))
    return named.groupBy("host").agg(F.count("*").alias("links"), F.countDistinct("canonical").alias("products"))


@query(f"""{CANONICAL} select page_id as line, canonical, min(page_id) over (partition by canonical) as first_line,
 case when page_id > min(page_id) over (partition by canonical) then 'duplicate' else 'ok' end as status from canon""")
def plan_dedupe(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(F.col("page_id").alias("line"), F.col("url").alias("raw"))
    return ledger.plan(links).select("line", "canonical", "first_line", "status")


@query(f"""{CANONICAL}, n as (select host, count(distinct canonical) as n from canon group by host),
 r as (select sum(n)::bigint as accepted, count(*)::bigint as hosts, greatest(max(n) * 2.0, sum(n) / 5.0 * 1.5) as raw from n)
 select accepted, hosts, trunc(raw)::bigint as low, trunc(raw * 2.2)::bigint as high from r""")
def plan_estimate(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(F.col("page_id").alias("line"), F.col("url").alias("raw"))
    return ledger.estimate(ledger.plan(links))


@query("""with p as (select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title,
 regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) as h1 from pages)
 select page_id, title, h1, case when title <> '' and title <> h1 then 'title' when h1 <> '' then 'h1' else 'none' end as best from p""")
def title_from_html(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1).alias("h1")
    )
    best = F.when((F.col("title") != "") & (F.col("title") != F.col("h1")), "title").when(F.col("h1") != "", "h1").otherwise("none")
    return p.withColumn("best", best)


# ---------------------------------------------------------------- text, units, money

def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({columns})"


@query("""select doc_id, case when regexp_matches(substr(text, 1, 1), '[=+@\t\r-]') then '''' || text else text end as cell
 from (select doc_id, case when doc_id % 5 = 0 then '=' || text when doc_id % 5 = 1 then '-' || text else text end as text from documents)""")
def csv_injection_guard(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("="), "text")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("-"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", values.guarded(raw).alias("cell"))


def _case_of(factors: dict[str, float], unit: str) -> str:
    return "case " + " ".join(f"when {unit} = '{k.replace(chr(39), chr(39) * 2)}' then {v}" for k, v in factors.items()) + " end"


def _units(factors: dict[str, float]) -> str:
    units = _values([(k,) for k in factors], "unit")
    # a sign isn't part of a number, and nothing is no measure
    return f"""select p_partkey, unit, case when p_size <> 3 then round_even(abs(p_size - 3) / 2.0 * {_case_of(factors, 'unit')}, 0)::int end as base
     from part cross join {units}"""


def _measured(spark, sf_dir, factors):
    units = spark.createDataFrame([(k,) for k in factors], "unit string")
    parts = table(spark, sf_dir, "part").crossJoin(F.broadcast(units))
    text = F.concat_ws(" ", ((F.col("p_size") - 3) / 2).cast("string"), "unit")
    return parts.select("p_partkey", "unit", values.measured(text, factors).alias("base"))


@query(_units(values.GRAMS))
def units_weight(spark, sf_dir):
    return _measured(spark, sf_dir, values.GRAMS)


@query(_units(values.CENTIMETRES))
def units_length(spark, sf_dir):
    return _measured(spark, sf_dir, values.CENTIMETRES)


RATES = [("USD", 83.25), ("EUR", 90.5), ("INR", 1.0)]


@query(f"""select l_orderkey, l_linenumber, code, case when code = 'INR' then round_even(l_extendedprice, 0)::int end as copied,
 round_even(l_extendedprice * case when code = 'INR' then 1.0 else rate end::double, 0)::int as converted,
 round_even(l_extendedprice * case when code = 'INR' then 1.0 else rate end::double * 1.15::double, 0)::int as marked_up
 from lineitem join (select code, rate::double as rate from {_values(RATES, 'code, rate')}) on code = case l_orderkey % 3 when 0 then 'USD' when 1 then 'EUR' else 'INR' end""")
def price_strategies(spark, sf_dir):
    code = F.when(F.col("l_orderkey") % 3 == 0, "USD").when(F.col("l_orderkey") % 3 == 1, "EUR").otherwise("INR")
    fx = F.broadcast(spark.createDataFrame(RATES, "code string, rate double"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", code.alias("code")).join(fx, "code")
    price = lambda how, m=0.0: values.price_inr(F.col("l_extendedprice"), F.col("code"), F.col("rate"), how, m)
    return rows.select("l_orderkey", "l_linenumber", "code", price("copy").alias("copied"), price("convert").alias("converted"), price("markup", 15.0).alias("marked_up"))


# ---------------------------------------------------------------- enrichment


def _match(text: str, kw: str, plural: bool = True) -> str:
    return f"regexp_matches({text}, '(?i)(^|[^\\w]){kw}{'(e?s)?' if plural else ''}([^\\w]|$)')"


def _winner_sql(scores: list[tuple[str, str]]) -> str:
    """The only best slug with 3 or more among struct-free columns."""
    top = f"greatest({', '.join(s for _, s in scores)})" if len(scores) > 1 else scores[0][1]
    ties = " + ".join(f"(({s}) = {top})::int" for _, s in scores)
    return f"case when {top} >= 3 and ({ties}) = 1 then case {' '.join(f'when ({s}) = {top} then {chr(39)}{k}{chr(39)}' for k, s in scores)} end end"


def _score_sql(words: str) -> str:
    return "(0" + "".join(f" + {n} * {_match(text, kw)}::int" for kw in words for text, n in (("name", 3), ("told", 1), ("trail", 5))) + ")"


_NAMED = """(select p_partkey, p_name || case p_partkey % 4 when 0 then ' silver necklace' when 1 then ' handloom saree' when 2 then ' bag' else '' end as name,
 case when p_partkey % 3 = 0 then 'Kurtas, a shawl and necklaces' when p_partkey % 7 = 1 then 'for men in gold' else '' end as told,
 case when p_partkey % 5 = 0 then 'Home > Sarees' when p_partkey % 11 = 2 then 'Bags, Jewellery sets' else '' end as trail from part)"""
CATEGORY = f"""with s as (select p_partkey, name, {', '.join(f'{_score_sql(w)} as "c{k}"' for k, w in enumerate(dims.CATEGORIES.values()))},
 {', '.join(f'{_score_sql(w)} as "s{k}"' for k, w in enumerate(dims.SHELVES.values()))} from {_NAMED}),
 f as (select *, {_winner_sql([(c, f'"c{k}"') for k, c in enumerate(dims.CATEGORIES)])} as found from s),
 g as (select p_partkey, name, coalesce(found, 'more-crafts') as category_slug, case found
 {' '.join(f"when '{c}' then " + _winner_sql([(x.split('/')[1], f'"s{k}"') for k, x in enumerate(dims.SHELVES) if x.startswith(c + '/')]) for c in dims.CATEGORIES if c != 'more-crafts')} end as subcategory_slug,
 case when found is null then array_to_string(string_split(name, ' ')[1:6], ' ') end as custom_category from f)"""


def _named_parts(spark, sf_dir):
    k = F.col("p_partkey") % 4
    more = F.when(k == 0, " silver necklace").when(k == 1, " handloom saree").when(k == 2, " bag").otherwise("")
    told = F.expr("case when p_partkey % 3 = 0 then 'Kurtas, a shawl and necklaces' when p_partkey % 7 = 1 then 'for men in gold' end")
    trail = F.expr("case when p_partkey % 5 = 0 then 'Home > Sarees' when p_partkey % 11 = 2 then 'Bags, Jewellery sets' end")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", more).alias("name"), told.alias("told"), trail.alias("trail"))


def classified(spark, sf_dir):
    found = enrich.look_up(_named_parts(spark, sf_dir), vocabulary.default_terms(spark), F.col("name"), F.col("told"), F.col("trail"))
    return enrich.classify(found, "name")


@query(f"{CATEGORY} select p_partkey, category_slug, subcategory_slug, custom_category from g")
def category_score(spark, sf_dir):
    return classified(spark, sf_dir).select("p_partkey", "category_slug", "subcategory_slug", "custom_category")


@query(f"""{CATEGORY} select p_partkey, case {' '.join(f"when category_slug = '{c}' and {_match('name', kw, False)} then '{code}'" for c, w in dims.HS_BY_MATERIAL.items() for kw, code in w.items())}
 {' '.join(f"when category_slug || '/' || subcategory_slug = '{k}' then '{v}'" for k, v in dims.HS_BY_SHELF.items())}
 {' '.join(f"when category_slug = '{k}' then '{v}'" for k, v in dims.HS_BY_CATEGORY.items())} end as hs_code from g""")
def hs_suggest(spark, sf_dir):
    return enrich.with_hs_code(classified(spark, sf_dir), vocabulary.default_codes(spark)).select("p_partkey", "hs_code")


_TERMS = [(c, t) for c, w in dims.POLICY.items() for t in w]
_STOCK = """(select p_partkey, p_name || case p_partkey % 5 when 0 then ' antique bone knife' when 1 then ' Certified coral' when 2 then ' boned' else '' end as name,
 case when p_partkey % 3 = 0 then 'A vintage piece, GI-tag and knife' else '' end as told from part)"""
_HIT = "regexp_matches({}, '(?i)(^|[^\\w])' || replace(term, '.', '[.]') || '([^\\w]|$)')"
_HITS = f"""with h as (select p_partkey, category, term, case when {_HIT.format('name')} then 'title' else 'description' end as field from {_STOCK} cross join {_values(_TERMS, 'category, term')}
 where {_HIT.format('name')} or {_HIT.format('told')})"""


def _hits(spark, sf_dir):
    k = F.col("p_partkey") % 5
    more = F.when(k == 0, " antique bone knife").when(k == 1, " Certified coral").when(k == 2, " boned").otherwise("")
    told = F.expr("case when p_partkey % 3 = 0 then 'A vintage piece, GI-tag and knife' end")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", more).alias("name"), told.alias("told"))
    found = enrich.look_up(rows, vocabulary.default_terms(spark), F.col("name"), F.col("told"))
    return found.select("p_partkey", F.explode(enrich.policy_hits(F.col("found"))).alias("hit")).select("p_partkey", "hit.*")


@query(f"{_HITS} select p_partkey, category, term, field from h")
def policy_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select("p_partkey", "category", "term", "field")


@query(f"{_HITS} select category, count(*)::bigint as hits, string_agg(distinct term, ', ' order by term) as terms from h group by category")
def policy_describe(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("category").agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"))


# ---------------------------------------------------------------- ledger

_OUTCOME = "case when o_orderstatus = 'F' then case o_orderkey % 3 when 0 then 'refused' when 1 then 'failed' else 'needs_human' end when o_orderstatus = 'O' then 'written' else case when o_orderkey % 2 = 0 then 'duplicate' end end"


def _outcomes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", F.expr(_OUTCOME).alias("outcome"))


@query(f"select coalesce({_OUTCOME}, 'pending') as outcome, count(*)::bigint as n from orders group by 1")
def outcome_counts(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy(F.coalesce("outcome", F.lit("pending")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""with o as (select {_OUTCOME} as outcome from orders), c as (select count(*)::bigint as total, count(*) filter (outcome is null)::bigint as pending,
 count(*) filter (outcome in ('written', 'needs_human'))::bigint as listed, count(*) filter (outcome = 'refused')::bigint as refused,
 count(*) filter (outcome = 'failed')::bigint as failed, count(*) filter (outcome in ('duplicate', 'invalid'))::bigint as set_aside from o)
 select *, pending = 0 and listed + refused + failed = total - set_aside as balanced from c""")
def accounting_check(spark, sf_dir):
    return ledger.accounting(_outcomes(spark, sf_dir))


_EDITS = """e as (select event_id as edit_id, user_id as c_custkey, ts as edited_at, case event_id % 2 when 0 then 'c_name' else 'c_mktsegment' end as field,
 case when event_id % 7 = 0 then '' else event_type end as value from events),
 l as (select c_custkey, field, arg_max(value, (edited_at, edit_id)) as value from e group by 1, 2)"""


@query(f"""with {_EDITS} select c.c_custkey, case when n.value is null then c.c_name else nullif(n.value, '') end as c_name,
 case when m.value is null then c.c_mktsegment else nullif(m.value, '') end as c_mktsegment, c.c_acctbal from customer c
 left join l n on n.c_custkey = c.c_custkey and n.field = 'c_name' left join l m on m.c_custkey = c.c_custkey and m.field = 'c_mktsegment'""")
def edits_overlay(spark, sf_dir):
    edits = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("edit_id"), F.col("user_id").alias("c_custkey"), F.col("ts").alias("edited_at"),
        F.when(F.col("event_id") % 2 == 0, "c_name").otherwise("c_mktsegment").alias("field"),
        F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("value"),
    )
    records = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return ledger.overlay(records, edits, "c_custkey", ["c_name", "c_mktsegment"])


@query(f"""select row_number() over (order by o_orderkey) - 1 as position, o_orderkey, c_name from orders join customer on o_custkey = c_custkey
 where {_OUTCOME} in ('written', 'needs_human')""")
def export_ordered(spark, sf_dir):
    wanted = _outcomes(spark, sf_dir).where("outcome in ('written', 'needs_human')")
    rows = wanted.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_orderkey", "c_name")
    return review.positions(rows, "o_orderkey")


@query(f"""select o_orderkey, {_OUTCOME} as outcome from orders where {_OUTCOME} in ('refused', 'failed')
 and not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0)""")
def failed_anti_join(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return _outcomes(spark, sf_dir).where("outcome in ('refused', 'failed')").join(known, "o_custkey", "left_anti").select("o_orderkey", "outcome")


@query(f"""select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey)::bigint as lines from orders where {_OUTCOME} is null
 or {_OUTCOME} in ('failed', 'refused')""")
def resume_todo(spark, sf_dir):
    orders = _outcomes(spark, sf_dir)
    done = orders.where("outcome in ('written', 'needs_human', 'duplicate')").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return orders.select("o_orderkey").join(done, "o_orderkey", "left_anti").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))


_SHEET = "m as (select (p_partkey - 1)::bigint as position, p_name || '#' || (p_partkey // 3) as canonical, p_name as title, p_retailprice as price from part where p_partkey % 3 = 0)"
_NEW = "n as (select p_partkey::bigint as seq, case when p_partkey % 11 = 0 then '' else p_name || '#' || (p_partkey // 3) end as canonical, p_type as title, p_size::double as price from part where p_partkey % 2 = 0 or p_partkey % 3 <> 0)"


def _sheet(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit("#"), F.expr("p_partkey div 3").cast("string"))
    master = part.where("p_partkey % 3 = 0").select((F.col("p_partkey") - 1).alias("position"), name.alias("canonical"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    new = part.where("p_partkey % 2 = 0 or p_partkey % 3 <> 0").select(
        F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 11 == 0, "").otherwise(name).alias("canonical"), F.col("p_type").alias("title"), F.col("p_size").cast("double").alias("price")
    )
    return master, new


_NEXT = "(select coalesce(max(position) + 1, 0) from m)"


@query(f"""with {_SHEET}, {_NEW}, f as (select * from n qualify canonical = '' or row_number() over (partition by canonical order by seq) = 1)
 select position, canonical, title, price from m union all select {_NEXT} + seq, canonical, title, price from f where canonical = '' or canonical not in (select canonical from m)""")
def master_skip(spark, sf_dir):
    return ledger.master_merge(*_sheet(spark, sf_dir), "skip")


@query(f"""with {_SHEET}, {_NEW}, f as (select * from n qualify canonical = '' or row_number() over (partition by canonical order by seq desc) = 1)
 select position, m.canonical, coalesce(f.title, m.title) as title, coalesce(f.price, m.price) as price from m left join f on f.canonical = m.canonical and f.canonical <> ''
 union all select {_NEXT} + seq, canonical, title, price from f where canonical = '' or canonical not in (select canonical from m)""")
def master_replace(spark, sf_dir):
    return ledger.master_merge(*_sheet(spark, sf_dir), "replace")


@query(f"with {_SHEET}, {_NEW} select position, canonical, title, price from m union all select {_NEXT} + seq, canonical, title, price from n")
def master_append(spark, sf_dir):
    return ledger.master_merge(*_sheet(spark, sf_dir), "append")


@query("""with t as (select max(ts) as now from events) select user_id, count(*)::bigint as seen, max(ts) as last_seen, arg_max(value, (ts, event_id)) as last_value
 from events, t where event_type = 'error' and ts >= now - interval 7 days group by user_id having count(*) >= 3""")
def domain_history_ttl(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    recent = ledger.fresh(events.where("event_type = 'error'").crossJoin(F.broadcast(now)), F.col("now"), 7, "ts")
    per = recent.groupBy("user_id").agg(F.count("*").alias("seen"), F.max("ts").alias("last_seen"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))
    return per.where("seen >= 3")


@query("""with r as (select user_id, ts, event_id, event_type = 'error' as bad, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) as island from events),
 g as (select user_id, island, count(*) filter (bad) as n from r group by 1, 2)
 select user_id, max(n)::bigint as longest, arg_max(n, island)::bigint as current from g group by 1""")
def refusal_streak(spark, sf_dir):
    return ledger.longest_refusals(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("""with d as (select o_orderkey as event_id from orders where o_totalprice < (select max(o_totalprice) from orders)), g as (select min(a.event_id + 1) as stop from d a where a.event_id + 1 not in (select event_id from d))
 select event_id from d, g where event_id < stop and (select min(event_id) from d) = 0""")
def contiguous_prefix(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    most = orders.agg(F.max("o_totalprice").alias("most"))
    done = orders.crossJoin(F.broadcast(most)).where("o_totalprice < most").select(F.col("o_orderkey").alias("event_id"))
    return ledger.contiguous_prefix(done, "event_id")


@query("""with w as (select user_id, ts, event_id, event_type, value, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)
 select user_id, event_type, value from w where r = 1""")
def latest_wins(spark, sf_dir):
    row = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("row")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(row).select("user_id", "row.*")


@query("select event_type, count(*)::bigint as n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as k from events group by 1")
def props_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("select o_orderkey, o_orderdate, o_totalprice from orders order by o_orderdate desc, o_orderkey desc limit 20")
def jobs_recent_topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 25 offset 100")
def rows_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(100).limit(25)


_REASON_WORDS = [*dims.REASONS, "no_title", ""]
_CLASS = " ".join(f"when '{r}' then '{k}'" for r, (k, _) in dims.REASONS.items())
_AGAIN = ", ".join(f"'{r}'" for r, (_, again) in dims.REASONS.items() if again)


@query(f"""with r as (select event_type, {_REASON_WORDS}[(event_id % {len(_REASON_WORDS)} + 1)::int] as reason from events)
 select event_type, reason, case reason {_CLASS} else 'failed' end as klass, reason in ({_AGAIN}) as retryable, count(*)::bigint as n from r group by all""")
def reason_classes(spark, sf_dir):
    reason = F.get(F.array(*map(F.lit, _REASON_WORDS)), (F.col("event_id") % len(_REASON_WORDS)).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_type", reason.alias("reason"))
    again = F.col("reason").isin([r for r, (_, a) in dims.REASONS.items() if a])
    return rows.groupBy("event_type", "reason", ledger.reason_class(F.col("reason")).alias("klass"), again.alias("retryable")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- review and images

_CELLS = """select c_custkey, case when c_custkey % 4 = 0 then null else c_name end as title, case when c_acctbal < 0 then null else c_acctbal end as price,
 case c_nationkey % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'none' end as confidence, c_mktsegment as category from customer"""


@query(f"""with c as ({_CELLS}) select c_custkey, array_to_string(list_filter([case when title is null then 'title' end, case when price is null then 'price' end,
 case when category is null then 'category' end], lambda x: x is not null), ' | ') as missing, case when title is not null and confidence in ('low', 'medium') then 'title:' || confidence else '' end as unsure,
 (case when title is null then '-' when confidence = 'high' then '3' when confidence = 'medium' then '2' when confidence = 'low' then '1' else '0' end)
 || (case when price is null then '-' else '3' end) as depths, title is null or price is null or confidence in ('low', 'medium') as needs_review from c""")
def review_cells(spark, sf_dir):
    columns = _CELLS.removeprefix("select ").removesuffix(" from customer")
    cells = table(spark, sf_dir, "customer").select(F.expr(f"struct({columns})").alias("x")).select("x.*")
    return review.review(cells, "c_custkey", "title", "price", ["title", "price", "category"])


_SHOTS = """select p_partkey as page, n as dom_index, 'https://cdn.example.com/img/p' || p_partkey || '-' || (n // 2) || case n % 2 when 0 then '_800x800' else '' end || '.jpg' as url,
 (p_size * (n + 3)) * 17 % 1600 as width, (p_size * (n + 1)) * 23 % 1600 as height, case n % 3 when 0 then 'structured' when 1 then 'og' else 'src' end as source
 from part, (select unnest(range(6)) as n)"""


def _shots(spark, sf_dir):
    n = spark.range(6).select(F.col("id").alias("n"))
    part = dealt(table(spark, sf_dir, "part"), "p_partkey").crossJoin(F.broadcast(n))
    return part.select(
        F.col("p_partkey").alias("page"), F.col("n").alias("dom_index"),
        F.expr("'https://cdn.example.com/img/p' || p_partkey || '-' || (n div 2) || case n % 2 when 0 then '_800x800' else '' end || '.jpg'").alias("url"),
        F.expr("(p_size * (n + 3)) * 17 % 1600").alias("width"), F.expr("(p_size * (n + 1)) * 23 % 1600").alias("height"),
        F.expr("case n % 3 when 0 then 'structured' when 1 then 'og' else 'src' end").alias("source"),
    )


@query(f"""with s as ({_SHOTS}), k as (select *, regexp_replace(lower(regexp_extract(url, '([^/]*)$', 1)), '_[0-9]+x[0-9]*([.][a-z]+)$', '\\1') as photo from s)
 select page, photo, dom_index, width * height as area from k qualify row_number() over (partition by page, photo order by width * height desc, dom_index) = 1""")
def photo_best_copy(spark, sf_dir):
    return images.best_copies(_shots(spark, sf_dir)).select("page", "photo", "dom_index", "area")


@query(f"""with s as ({_SHOTS}), t as (select *, case when width >= 800 and height >= 800 then 0 when width >= 800 or height >= 800 then 1 else 2 end as tier,
 case source when 'structured' then 0 when 'og' then 1 else 2 end as src from s)
 select page, dom_index, row_number() over (partition by page order by tier, -greatest(width, height), src, dom_index) as rank from t""")
def image_rank(spark, sf_dir):
    return images.ranked(_shots(spark, sf_dir)).select("page", "dom_index", "rank")


_REASON = """case when not starts_with(url, 'https://') then 'bad_url' when width = 0 or height = 0 then 'not_decodable' when width < 400 or height < 400 then 'below_hard_minimum'
 when width < 800 or height < 800 then 'below_min_dimensions' end"""


@query(f"""with s as ({_SHOTS}), r as (select page, dom_index, {_REASON} as reason from s), o as (select *, coalesce(sum((reason is null)::int) over (partition by page order by dom_index rows between unbounded preceding and 1 preceding), 0) as passed from r)
 select page, dom_index, coalesce(reason, 'ok') as verdict from o where passed < 2""")
def image_first_pass(spark, sf_dir):
    return images.walked(images.judged(_shots(spark, sf_dir)), 2).select("page", "dom_index", F.coalesce("reason", F.lit("ok")).alias("verdict"))


@query(f"""with s as ({_SHOTS}), r as (select *, {_REASON} as reason from s)
 select page, arg_max(dom_index, (width * height, -dom_index)) as dom_index, max(width * height) as area from r where reason = 'below_min_dimensions' group by page""")
def best_low_res(spark, sf_dir):
    low = images.judged(_shots(spark, sf_dir)).where("reason = 'below_min_dimensions'").withColumn("area", F.expr("width * height"))
    return low.groupBy("page").agg(F.max_by("dom_index", F.struct("area", -F.col("dom_index"))).alias("dom_index"), F.max("area").alias("area"))


@query(f"""with s as ({_SHOTS}), r as (select page, count(*) filter ({_REASON} is null) as passed, count(*) filter ({_REASON} = 'below_min_dimensions') as low from s group by page),
 g as (select page, passed > 0 as tier1_passed, passed = 0 and low = 0 as do_upload from r)
 select count(*)::bigint as pages, count(*) filter (do_upload)::bigint as uploads, count(*) filter (do_upload and tier1_passed)::bigint as violations from g""")
def gate_violations(spark, sf_dir):
    return images.gate_check(images.judged(_shots(spark, sf_dir)))


# ---------------------------------------------------------------- sources and streams


@query(r"""with t as (select page_id, 'see ' || url || ', or (' || url || ').' as line from pages),
 f as (select page_id, unnest(regexp_extract_all(line, 'https?://[^\s]+')) as raw, generate_subscripts(regexp_extract_all(line, 'https?://[^\s]+'), 1) - 1 as pos from t)
 select page_id, 2::bigint as line_no, pos::bigint as pos, regexp_replace(raw, '[.,;:!?)]+$', '') as link from f""")
def links_from_text(spark, sf_dir):
    text = F.concat(F.lit("links:\n"), F.lit("see "), "url", F.lit(", or ("), "url", F.lit(").\n\nnone here"))
    found = links.links_in_lines(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), "page_id", "text")
    return found.withColumns({"line_no": F.col("line_no").cast("long"), "pos": F.col("pos").cast("long")})


@query("""select p_name as title, count(*)::bigint as n, sum(round(p_retailprice, 2))::double as price, sum(p_size * 1000)::bigint as weight_g,
 sum(1)::bigint as images from part group by 1""")
def export_records(spark, sf_dir):
    aliases = {"title": ["title", "product name"], "price": ["price", "mrp"], "weight": ["weight", "item weight"], "images": ["image urls", "images"]}
    sheet = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("Product Name"), F.concat(F.lit("Rs "), F.round("p_retailprice", 2).cast("decimal(18,2)").cast("string")).alias("Price (INR)"),
        F.concat(F.col("p_size").cast("string"), F.lit(" kg")).alias("Item Weight"), F.lit("https://a.example/1.jpg; no link").alias("Image URLs"), F.lit(1).alias("Stock"),
    )
    rows = exports.named(sheet, exports.map_columns(sheet.columns, aliases))
    return rows.groupBy("title").agg(
        F.count("*").alias("n"), F.sum(exports.number(F.col("price"))).alias("price"),
        F.sum(exports.grams(F.col("weight"))).alias("weight_g"), F.sum(F.size(exports.image_links(F.col("images"))).cast("long")).alias("images"),
    )


@query("""with w as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)
 select user_id, event_id, event_type from w where r = 1""")
def stream_latest_outcomes(spark, sf_dir):
    base = fresh_path(spark, "outcomes")
    source = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    # a pattern, as the stream's reader takes a plain path for a folder
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]")
    outcomes.write_outcomes(stream, f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    latest = outcomes.latest_outcomes(spark, f"{base}/rows", source.schema, "user_id", ["ts", "event_id"])
    return latest.select("user_id", "event_id", "event_type")


# ---------------------------------------------------------------- gates

#: Words of a fetcher, by an event's number.
_WORDS = ["transport_reset", "connection_refused", "tls_error", "dns_error", "http_401", "http_403", "http_404", "http_429", "http_503", "http_5x", "not_html", "other"]


@query(f"""with w as (select {_WORDS}[(event_id % {len(_WORDS)} + 1)::int] as word from events),
 r as (select word, case when word = 'transport_reset' then 'timeout_read' when word in ('connection_refused', 'tls_error') then 'timeout_connect'
   when word = 'dns_error' then 'dns_failure' when word in ('http_401', 'http_403') then 'blocked_403' when word = 'http_429' then 'blocked_429'
   when word = 'not_html' or word like 'http@_4%' escape '@' then 'not_a_product_page' when word like 'http@_5%' escape '@' then 'http_error_5xx'
   else 'timeout_read' end as reason, try_cast(nullif(regexp_extract(word, '^http_([0-9]+)$', 1), '') as integer) as status from w)
 select reason, status, count(*)::bigint as n from r group by 1, 2""")
def fetch_reasons(spark, sf_dir):
    word = F.get(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % len(_WORDS)).cast("int"))
    words = table(spark, sf_dir, "events").select(word.alias("word"))
    return words.groupBy(gates.fetch_reason(F.col("word")).alias("reason"), gates.fetch_status(F.col("word")).alias("status")).agg(F.count("*").alias("n"))


@query("""with s as (select p_partkey, case p_partkey % 4 when 0 then 'handwoven-textiles' when 1 then 'apparel' when 2 then 'pottery' else '' end as c,
   case p_partkey % 3 when 0 then 'sarees' when 1 then 'bowls' else '' end as k from part)
 select p_partkey, case when c = 'pottery' then 'unknown_category_slug:pottery' when k = '' then null when c = '' then 'subcategory_without_category:' || k
   when c = 'handwoven-textiles' and k = 'sarees' then null else 'unknown_subcategory_slug:' || c || '/' || k end as fault from s""")
def slug_faults(spark, sf_dir):
    key = F.col("p_partkey")
    category = F.get(F.array(*map(F.lit, ["handwoven-textiles", "apparel", "pottery", ""])), (key % 4).cast("int"))
    shelf = F.get(F.array(*map(F.lit, ["sarees", "bowls", ""])), (key % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", gates.slug_fault(category, shelf).alias("fault"))
