"""Queries of checks, counts and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareloom.functions import texts, urls
from wareloom.operators import checks, plugins, records, reports
from wareloom.plans.registry import _OUTCOME, _outcomes, dealt, query, table
from wareloom.scratch import fresh_path
from wareloom.sources import readers, scripts
from wareloom.streaming import outcomes as streams

# ---------------------------------------------------------------- checks

_SHOT = """select p_partkey, case when p_partkey % 29 = 0 then 'ftp://a/x.jpg' else concat('https://', case when p_partkey % 23 = 0 then 'bad.example' else 'cdn.example' end, '/', p_partkey, case when p_partkey % 19 = 0 then '.jpg?Signature=1' else '.jpg' end) end as url,
 case when p_partkey % 23 = 0 then 'bad.example' else 'cdn.example' end as host, case when p_partkey % 17 = 0 then 404 else 200 end as status, case when p_partkey % 13 = 0 then 6 when p_partkey % 11 = 0 then 1 else 0 end as hops,
 case when p_partkey % 22 = 0 then '/captcha' else '/x.jpg' end as final_path, case when p_partkey % 33 = 0 then 'text/html; charset=utf-8' when p_partkey % 31 = 0 then '' else 'image/jpeg' end as content_type,
 case when p_partkey % 5 = 0 then p_size * 100 end as content_length, p_partkey % 7 <> 0 as decodable, p_size * 40 as width, 900 as height, p_partkey % 3 <> 0 as hotlink_ok from {}"""
_FAULT = """case when p_partkey % 29 = 0 then 'bad_syntax' when p_partkey % 19 = 0 then 'signed_or_expiring_url' when p_partkey % 23 = 0 then 'host_known_to_block' when p_partkey % 17 = 0 then 'unreachable'
 when p_partkey % 13 = 0 then 'too_many_redirects' when p_partkey % 22 = 0 then 'redirect_to_interstitial' when p_partkey % 33 = 0 then 'redirect_to_html' when p_partkey % 31 = 0 then 'wrong_content_type'
 when p_partkey % 5 = 0 and p_size * 100 between 26 and 10239 then 'too_small' when p_partkey % 7 = 0 then 'not_decodable' when p_size * 40 < 400 then 'unusably_small' when p_size * 40 < 800 then 'below_min_dimensions'
 when p_partkey % 3 = 0 then 'hotlink_blocked' end"""


def _judged(spark, sf_dir):
    columns = _SHOT.removeprefix("select ").removesuffix(" from {}")
    shots = table(spark, sf_dir, "part").select(F.expr(f"struct({columns})").alias("x")).select("x.*")
    return shots.withColumn("reason", checks.picture_fault(["bad.example"]))


@query(f"select p_partkey, {_FAULT} as reason from part")
def picture_faults(spark, sf_dir):
    return _judged(spark, sf_dir).select("p_partkey", "reason")


_PLACES = " ".join(f"when '{reason}' then {[p for p, _ in checks.PREDICATES].index(n)}" for reason, n in checks.FAILED_BY.items())
_NAMES = ", ".join(f"({k}, {n}, '{name}')" for k, (n, name) in enumerate(checks.PREDICATES))


@query(f"""with f as (select p_partkey, coalesce(case {_FAULT} {_PLACES} end, 9) as stops from part), p as (select * from (values {_NAMES}) v(place, predicate, name))
 select p_partkey, place, predicate, name, case when place < stops then 'ok' when place = stops then 'fail' else 'not reached' end as outcome from f, p""")
def predicate_steps(spark, sf_dir):
    return checks.steps(_judged(spark, sf_dir), ["p_partkey"])


@query(f"select coalesce({_FAULT}, 'ok') as reason, count(*)::bigint as n from part group by 1")
def picture_fault_counts(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("""with p as (select p_partkey, p_partkey % 4 = 0 as captcha, p_partkey % 3 = 0 as login, p_partkey % 5 = 0 as gone, p_partkey % 2 = 0 as cart, p_partkey % 7 = 0 as node from part)
 select p_partkey, case when captcha then 'bot_challenge' when login and not (cart or node) then 'sign_in_required' when gone and not (cart or node) then 'not_a_product_page' end as verdict,
 cart or node as product, array_to_string(list_filter([case when captcha then 'body: robot check' end, case when login then 'body: members only' end, case when gone then 'buy-box: page not found' end], lambda x: x is not null), ' | ') as evidence from p""")
def page_shapes(spark, sf_dir):
    html = F.expr(
        "concat('<body>', if(p_partkey % 4 = 0, 'Robot Check ', ''), if(p_partkey % 3 = 0, 'Members Only ', ''), if(p_partkey % 5 = 0, '<div id=buybox>Page not found</div>', ''), if(p_partkey % 2 = 0, 'Add to cart', ''), p_name)"
    )
    box = F.expr("if(p_partkey % 5 = 0, 'Page not found', '')")
    shape = checks.page_shape(html, F.lit("https://a.example/x"), box, F.col("p_partkey") % 7 == 0)
    found = table(spark, sf_dir, "part").select("p_partkey", shape.alias("s"))
    return found.select("p_partkey", "s.verdict", "s.product", F.array_join("s.evidence", " | ").alias("evidence"))


@query("""select page_id, case when page_id % 5 = 0 then false when page_id % 3 = 0 then true else not (regexp_extract(url, '://[^/?#]*([^?#]*)', 1) like '/en%') end as allowed,
 case page_id % 4 when 0 then 'private' when 1 then 'metadata' when 2 then 'loopback' end as fault, case when page_id % 2 = 0 then 1.5 else 3.0 end::double as wait from pages""")
def page_permissions(spark, sf_dir):
    status = F.expr("case when page_id % 5 = 0 then 403 when page_id % 3 = 0 then 404 else 200 end").cast("double")
    rules = F.lit("User-agent: *\nDisallow: /en\n")
    target = F.expr("element_at(array('http://10.0.0.1/', 'http://169.254.169.254/x', 'https://[::ffff:127.0.0.1]/', 'https://8.8.8.8/'), cast(page_id % 4 as int) + 1)")
    return table(spark, sf_dir, "pages").select(
        "page_id", checks.robots_allow(rules, status, F.col("url")).alias("allowed"), checks.address_fault(target).alias("fault"), checks.backoff(F.col("page_id") % 2 + 2, 0.75).alias("wait")
    )


@query("""select user_id, count(*) filter (event_type = 'error')::int = 1 or count(*) filter (event_type = 'view') > 0 as browser from events group by user_id
 having count(*) filter (event_type = 'purchase') = 0 union all select user_id, false from events group by user_id having count(*) filter (event_type = 'purchase') > 0""")
def browser_escalation(spark, sf_dir):
    kind = F.expr("case event_type when 'view' then 'timeout' when 'purchase' then 'not_html' else 'refused' end").alias("kind")
    status = F.expr("case when event_type = 'error' then 403 end").alias("status")
    attempts = table(spark, sf_dir, "events").select("user_id", kind, status)
    # what decides are a few facts of a key's attempts, so each is kept once or twice, not all of them
    few = attempts.groupBy("user_id", "kind", "status").agg(F.least(F.count("*"), F.lit(2)).alias("n"))
    grouped = few.groupBy("user_id").agg(F.flatten(F.collect_list(F.expr("array_repeat(struct(kind, status), cast(n as int))"))).alias("attempts"))
    return grouped.select("user_id", checks.escalates(F.col("attempts")).alias("browser"))


# ---------------------------------------------------------------- counts


@query(f"""with o as (select {_OUTCOME} as outcome from orders) select count(*)::bigint as seen, count(outcome)::bigint as processed, count(*) filter (outcome = 'written')::bigint as written, count(*) filter (outcome = 'needs_human')::bigint as review,
 count(*) filter (outcome = 'failed')::bigint as failed, count(*) filter (outcome = 'refused')::bigint as refused, count(*) filter (outcome in ('duplicate', 'invalid'))::bigint as skipped from o""")
def batch_stats(spark, sf_dir):
    return reports.batch_stats(_outcomes(spark, sf_dir))


@query("""with f as (select p_size % 4 as image_count, p_size % 5 = 0 as low_res, case when p_partkey % 9 = 0 then 'x' end as reason, p_partkey % 6 = 0 as cached from part)
 select count(*)::bigint as rows, count(*) filter (image_count > 0 and reason is null)::bigint as with_photo, count(*) filter (image_count = 0 and reason is null)::bigint as without_photo,
 count(*) filter (image_count > 0 and low_res)::bigint as low_res, count(reason)::bigint as failed, count(*) filter (cached)::bigint as cached from f""")
def find_stats(spark, sf_dir):
    found = table(spark, sf_dir, "part").selectExpr("p_size % 4 as image_count", "p_size % 5 = 0 as low_res", "case when p_partkey % 9 = 0 then 'x' end as reason", "p_partkey % 6 = 0 as cached")
    return reports.find_stats(found)


@query("""with l as (select user_id, max((ts, event_id)) filter (event_type <> 'error') as ok from events group by 1)
 select e.user_id, count(*)::bigint as failures, max(ts) as last_failure from events e join l using (user_id) where event_type = 'error' and (ok is null or (ts, event_id) > ok) group by 1""")
def hotlink_failures(spark, sf_dir):
    return reports.failures_since_success(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("""select t as event_type, (select count(*) from events where event_type = t)::bigint as n from (values ('click'), ('error'), ('view'), ('nothing')) v(t)""")
def trace_counts(spark, sf_dir):
    return reports.zero_filled(table(spark, sf_dir, "events"), "event_type", ["click", "error", "view", "nothing"])


@query("""select count(*)::bigint as rows, count(distinct nullif(case when o_custkey % 7 = 0 then '' else 'j_' || o_custkey % 50 end, ''))::bigint as jobs, min(o_orderdate) as first_added, max(o_orderdate) as last_added from orders""")
def sheet_summary(spark, sf_dir):
    job = F.expr("case when o_custkey % 7 = 0 then '' else concat('j_', o_custkey % 50) end").alias("job_id")
    return reports.sheet_summary(table(spark, sf_dir, "orders").select(job, F.col("o_orderdate").alias("added_at")))


@query("""select count(distinct (user_id, event_type))::bigint as pending_edits, count(distinct user_id)::bigint as rows_edited from events""")
def edit_counts(spark, sf_dir):
    return reports.edit_counts(table(spark, sf_dir, "events").select(F.col("user_id").alias("row_key"), F.col("event_type").alias("field")))


@query("""with e as (select user_id, case event_id % 2 when 0 then 'c_name' else 'c_mktsegment' end as field, arg_max(case when event_id % 7 = 0 then '' else event_type end, (ts, event_id)) as edit from events group by 1, 2),
 l as (select c_custkey, 'c_name' as field, c_name as original from customer union all select c_custkey, 'c_mktsegment', c_mktsegment from customer)
 select c_custkey, l.field, case when edit is null then original else nullif(edit, '') end as value, original, edit is not null as edited, l.field = 'c_mktsegment' as locked from l left join e on user_id = c_custkey and e.field = l.field""")
def cell_table(spark, sf_dir):
    edits = table(spark, sf_dir, "events").selectExpr(
        "user_id as c_custkey", "event_id as edit_id", "ts as edited_at", "case event_id % 2 when 0 then 'c_name' else 'c_mktsegment' end as field", "case when event_id % 7 = 0 then '' else event_type end as value"
    )
    return reports.cell_table(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"], edits, ["c_mktsegment"])


@query("""select p_partkey, case when p_size % 3 = 0 then 'no_candidates' when p_size % 3 = 1 then 'too_small' else 'too_small, ' || p_type end as why,
 array_to_string(list_filter(['title', case when p_partkey % 2 = 1 then 'price' end], lambda x: x is not null), ', ') as incomplete from part""")
def reason_summaries(spark, sf_dir):
    reasons = F.expr("case p_size % 3 when 0 then cast(array() as array<string>) when 1 then array('too_small', null, 'too_small') else array('too_small', p_type) end")
    lacks = records.incomplete_reasons(["title", "description", "price"], {"title": F.lit(False), "description": F.lit(True), "price": F.col("p_partkey") % 2 == 0})
    return table(spark, sf_dir, "part").select("p_partkey", reports.reason_summary(reasons).alias("why"), F.array_join(lacks, ", ").alias("incomplete"))


@query("""with h as (select 'h' || user_id as host, max(ts) as last_seen, count(*) as n, arg_max(event_type, (ts, event_id)) as reason from events where event_type = 'error' group by 1), t as (select max(ts) as now from events),
 p as (select 'h' || o_custkey as host, count(*) as links from orders where o_orderkey % 2 = 0 group by 1)
 select p.host, links::bigint as links, coalesce(n, 0)::bigint as refused, reason from p left join (select h.* from h, t where last_seen >= now - interval 30 days) h on h.host = p.host""")
def preflight_hosts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    history = events.where("event_type = 'error'").groupBy(F.expr("concat('h', user_id)").alias("host")).agg(
        F.max("ts").alias("last_seen"), F.count("*").alias("count"), F.max_by("event_type", F.struct("ts", "event_id")).alias("reason")
    )
    now = events.agg(F.max("ts").alias("now"))
    plan = table(spark, sf_dir, "orders").selectExpr("concat('h', o_custkey) as host", "if(o_orderkey % 2 = 0, 'ok', 'duplicate') as status")
    return reports.preflight(plan, history.crossJoin(F.broadcast(now)), F.col("now"))


@query("""select p_name || p_type as content, min(p_partkey) as p_partkey, sha256(p_name || p_type) as sha256 from part group by 1, 3""")
def upload_dedupe(spark, sf_dir):
    return reports.by_content(table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", "p_type").alias("content")), "content", "p_partkey")


# ---------------------------------------------------------------- plug-ins, readers, streams


def _shop_pages(spark, sf_dir):
    cents = "cast(round(p_retailprice * 100) as bigint)"
    html = F.expr(
        f"case p_partkey % 3 when 0 then concat('<script src=\"/cdn/shop/x.js\"></script><script>var meta = {{\"product\":{{\"variants\":[{{\"price\":', {cents} + 500, ',\"public_title\":\"m\"}},{{\"price\":', {cents}, ',\"public_title\":\"L\"}}]}}}};</script>')"
        " when 1 then concat('<span id=\"productTitle\"> ', p_name, '  x </span><div id=\"availability\"><span> In stock. </span></div><div id=\"corePrice_d\"><span class=\"a-offscreen\">₹', p_size, '00.00</span></div><script>P.when(''A'').execute({ \\'colorImages\\': { \\'initial\\': [{\"hiRes\":\"https://m.media-amazon.com/images/I/', p_partkey, '._SL1_.jpg\",\"alt\":\"a ] b\"}]}, x: 1});</script>') else p_name end"
    )
    url = F.expr("concat(if(p_partkey % 3 = 1, 'https://www.amazon.in/dp/', 'https://shop.example/'), p_partkey)")
    made = dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", url.alias("url"), html.alias("html"), F.expr("array('own.jpg')").alias("image_candidates"))
    return plugins.apply(records.complete(made), [plugins.MARKETPLACE, plugins.SHOP_SYSTEM])


_MEDIA = "https://m.media-amazon.com/images/I/"


@query(f"""with u as (select p_partkey, '{_MEDIA}' || p_partkey as base from part)
 select p_partkey, array_to_string([base || 'b.jpg', base || 'b._SX90_.jpg', base || 'a.jpg', base || 'a._SX50_.jpg', base || 'o.jpg', base || 'o._AC_SL1500_.jpg',
  base || 'h.jpg', base || 'l.jpg', base || 'l._SX9_.jpg', base || 't.jpg', base || 't._SS40_.jpg'], ' ') as links from u""")
def gallery_pictures(spark, sf_dir):
    base = f"'{_MEDIA}', p_partkey"
    html = f"""concat('<div id="imgTagWrapperId"><img id="landingImage" data-old-hires="', {base}, 'o._AC_SL1500_.jpg" src="/images/G/01/play-icon.png" data-a-dynamic-image="{{&quot;', {base}, 'a._SX50_.jpg&quot;:[50,', 40 + p_size,
     '],&quot;', {base}, 'b._SX90_.jpg&quot;:[90,100],&quot;https://other.example/c.jpg&quot;:[900,900]}}"></div><script>var obj = {{title: "[", \\'colorImages\\' : {{ "initial": [{{"large":"x","hiRes":"', {base}, 'h.jpg","alt":"one ] [[ \\\\" }}"}},',
     '{{"hiRes":null,"large":"', replace('{_MEDIA}', 'https:', ''), p_partkey, 'l._SX9_.jpg"}},{{"mainUrl":"https://m.media-amazon.com/images/G/01/sprite-x.jpg"}}, 7]}}, more: [1,2]}};</script><ul id="altImages"><li><img src="', {base}, 't._SS40_.jpg"></ul>')"""
    pages = dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.expr(html).alias("html"))
    return pages.select("p_partkey", F.array_join(plugins.ranked_gallery(scripts.gallery_of(F.col("html"))), " ").alias("links"))


@query("""select p_partkey, case p_partkey % 3 when 0 then 'shop-system' when 1 then 'marketplace' end as plugin, case when p_partkey % 3 = 1 then p_name || ' x' end as title, case when p_partkey % 3 = 0 then 'M,L' end as sizes,
 case when p_partkey % 3 = 1 then 'in_stock' end as availability, case when p_partkey % 3 = 1 and p_size > 0 then p_size * 100 end as price_inr, case when p_partkey % 3 = 1 then 'https://m.media-amazon.com/images/I/' || p_partkey || '.jpg | https://m.media-amazon.com/images/I/' || p_partkey || '._SL1_.jpg | own.jpg' else 'own.jpg' end as pictures,
 case when p_partkey % 3 = 0 then cast(round(p_retailprice * 100) as bigint) / 100.0 end::double as lowest, case when p_partkey % 3 = 0 then 2 end as prices from part""")
def plugin_cells(spark, sf_dir):
    low = plugins.lowest_price(F.col("html"))
    return _shop_pages(spark, sf_dir).select(
        "p_partkey", "plugin", *[F.col(c)["value"].alias(c) for c in ("title", "sizes", "availability", "price_inr")], F.array_join("image_candidates", " | ").alias("pictures"),
        low["price"].alias("lowest"), low["prices"].alias("prices"),
    )


@query("""select p_partkey::varchar as key, 'https://a.example/' || p_partkey as link, case when p_partkey % 2 = 0 then 'https://b.example/' || p_partkey end as second, p_name as name from part""")
def delimited_upload(spark, sf_dir):
    path = fresh_path(spark, "upload")
    part = table(spark, sf_dir, "part")
    cells = "p_partkey as key", "p_name as name", "if(p_partkey % 2 = 0, concat('https://b.example/', p_partkey), 'none') as other", "concat(' https://a.example/', p_partkey) as page"
    part.selectExpr(*cells).write.csv(path, sep=";", header=True)
    return readers.read_delimited(spark, path).select("key", "link", F.get("more_links", F.lit(0)).alias("second"), "name")


#: Bytes of the smallest and the largest split of an export. A task sorts the lines of its splits.
LEAST_SPLIT, MOST_SPLIT = 10_000, 8 << 20


def split_size(total: int) -> int:
    """Bytes of a split of an export: small enough that records lie across them, and never more as the export grows."""
    return min(MOST_SPLIT, max(LEAST_SPLIT, total // 24))


@query("""select o_orderkey, o_orderkey || chr(10) || 'say "' || o_orderpriority || '", ' || chr(10) as note, o_orderstatus || '"' as mark from orders""")
def quoted_export(spark, sf_dir):
    path = fresh_path(spark, "export")
    note = F.expr("concat(o_orderkey, '\n', 'say \"', o_orderpriority, '\", ', '\n')")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), F.expr("concat(o_orderstatus, '\"')").alias("mark"))
    orders.write.csv(path, header=True, escape='"', ignoreTrailingWhiteSpace=False)
    # small splits, so that records lie across them at every size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    size = split_size(sum(f["length"] for f in spark.read.format("binaryFile").load(path).select("length").collect()))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        rows = readers.read_export(spark, path).select(F.col("o_orderkey").cast("long"), "note", "mark")
        rows.write.parquet(f"{path}-rows")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return spark.read.schema(rows.schema).parquet(f"{path}-rows")


@query("""with d as (select o_orderkey as k from orders where o_totalprice < (select max(o_totalprice) from orders)), g as (select min(a.k + 1) as stop from d a where a.k + 1 not in (select k from d))
 select k as input_index from d, g where k < stop and (select min(k) from d) = 0""")
def stream_prefix(spark, sf_dir):
    base = fresh_path(spark, "prefix")
    orders = table(spark, sf_dir, "orders")
    most = orders.agg(F.max("o_totalprice")).first()[0]
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parque[t]")
    done = stream.where(F.col("o_totalprice") < F.lit(most)).select(F.col("o_orderkey").alias("input_index"))
    streams.write_prefix(done, "input_index", f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("input_index long").parquet(f"{base}/rows/out/batch=*")


@query("""select user_id::varchar as canonical, count(*) >= 1 as done from events group by 1""")
def stream_resume(spark, sf_dir):
    base = fresh_path(spark, "resume")
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]").select(F.col("user_id").cast("string").alias("canonical"))
    streams.write_once(stream, "canonical", f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("canonical string").parquet(f"{base}/rows").select("canonical", F.lit(True).alias("done"))


@query("""select page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host, regexp_extract(url, '://[^/?#]*([^#]*)', 1) as rest, regexp_replace(url, '[?&]$', '') as kept from (select page_id, regexp_replace(regexp_replace(url, '\\?ref=x', ''), '&ref=x', '') as url from pages)""")
def link_parts(spark, sf_dir):
    link = urls.without_params(F.col("url"), ["REF"])
    return table(spark, sf_dir, "pages").select("page_id", urls.host(link).alias("host"), urls.path_and_query(link).alias("rest"), link.alias("kept"))
