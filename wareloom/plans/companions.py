"""Queries of the tables beside a listing file, over the records that are made from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareloom.operators import companions
from wareloom.plans import records as made
from wareloom.plans.registry import query, table

_REASON = "case p_partkey % 4 when 0 then 'http_404' when 1 then 'robots_disallowed' when 2 then 'timeout_read' end"
_FACTS = {
    "row_key": "cast(p_partkey as string)", "source_url": "concat('https://a.example/', p_partkey)", "title_original": "if(p_partkey % 3 = 0, concat(p_name, ' | shop'), p_name)", "provenance": "'own'",
    "source_price": "cast(p_size as double)", "source_currency": "if(p_partkey % 2 = 0, 'USD', null)", "fx_rate_used": "if(p_partkey % 2 = 0, 83.5D, null)", "fx_rate_as_of": "'2024-01-01'",
    "gi_mention_found": "if(p_partkey % 29 = 0, 'GI tag', null)", "image_method": "if(p_partkey % 3 = 0, 'none', 'hotlink')", "image_problem": "if(p_partkey % 6 = 0, 'too_small', null)",
    "image_reason": "if(p_partkey % 3 = 0, 'below 400', null)", "fetch_stage": "'static'", "failure_reason": _REASON, "http_status": "cast(if(p_partkey % 8 = 1, 403, 0) as int)",
    "rungs_tried": "if(p_partkey % 2 = 0, 'A1 A2', null)", "time_spent": "'3s'", "fetched_at": "timestamp'2024-01-02 03:04:05'",
}


def _told(spark, sf_dir):
    more = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_k"), *[F.expr(v).alias(n) for n, v in _FACTS.items()])
    return made.part_records(spark, sf_dir).drop(*_FACTS).join(more, F.col("p_partkey") == F.col("_k")).drop("_k")


@query(f"""with {made.RECORDS}, f as (select r.*, p.p_name from r join part p using (p_partkey)) select p_partkey::varchar as row_key, 'https://a.example/' || p_partkey as source_url,
 case when p_partkey % 3 = 0 then p_name || ' | shop' when p_name <> coalesce(title, '') then p_name else '' end as title_original, 'own' as provenance, status, case when p_partkey % 17 = 0 then 'f1 | f2' else '' end as policy_flags,
 array_to_string(list_filter([{made.MISSING}], lambda x: x is not null), ' | ') as missing_required, array_to_string(list_filter([{made.UNSURE}], lambda x: x is not null), ' | ') as low_confidence_fields, p_size::double::varchar as source_price,
 case when p_partkey % 2 = 0 then 'USD' else '' end as source_currency, case when p_partkey % 2 = 0 then '83.5 @ 2024-01-01' else '' end as fx_rate_used, '' as suggested_hs_code, case when p_partkey % 29 = 0 then 'GI tag' else '' end as gi_mention_found,
 case when p_partkey % 3 = 0 then 'none' else 'hotlink' end as image_method, case when p_partkey % 6 = 0 then 'too_small' else '' end as image_problem, case when p_partkey % 3 = 0 then 'below 400' else '' end as image_reason, 'static' as fetch_stage,
 case when p_partkey % 13 = 0 then 'look' else coalesce({_REASON}, '') end as notes from f where status <> 'failed' and not bare""")
def review_table(spark, sf_dir):
    return companions.review_table(_told(spark, sf_dir)).drop("local_image_path")


@query(f"""with {made.RECORDS}, o as (select 'https://a.example/' || (o_orderkey % 3000) as source_url, case o_orderkey % 5 when 0 then 'failed' when 1 then 'refused' else 'written' end as outcome,
  case o_orderkey % 3 when 0 then 'http_503' when 1 then 'blocked_403' end as reason, o_orderdate from orders),
 a as (select 'https://a.example/' || p_partkey as source_url, coalesce({_REASON}, 'unknown') as reason, 'static' as stage,
  case when p_partkey % 8 = 1 then '403' when p_partkey % 4 = 0 then '404' else '' end as http_status, case when p_partkey % 2 = 0 then 'A1 A2' else '' end as rungs_tried, '3s' as time_spent, '2024-01-02T03:04:05' as attempted_at from r where status = 'failed'
  union all select source_url, coalesce(reason, 'unknown'), 'not_attempted', case when reason = 'http_503' then '503' else '' end, '', '', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') from o
   where outcome <> 'written' and source_url not in (select 'https://a.example/' || p_partkey from part))
 select *, case when reason in ('robots_disallowed', 'blocked_403') then 'refused' else 'failed' end as class from a""")
def failed_table(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").selectExpr(
        "concat('https://a.example/', o_orderkey % 3000) as source_url", "case o_orderkey % 5 when 0 then 'failed' when 1 then 'refused' else 'written' end as outcome",
        "case o_orderkey % 3 when 0 then 'http_503' when 1 then 'blocked_403' end as reason", "cast(o_orderdate as timestamp) as decided_at",
    )
    return companions.failed_table(_told(spark, sf_dir), plan)


@query("""select p_partkey as line, p_brand as mine, 'https://a.example/' || p_partkey as source_url, chr(39) || '=' || p_name as title, (p_size % 12)::varchar as image_count, '' as method,
 case when p_size % 12 >= 11 then 'https://p.example/11' else '' end as image_url_11, '' as description from part""")
def links_table(spark, sf_dir):
    links = F.expr("transform(slice(sequence(1, 12), 1, p_size % 12), k -> concat('https://p.example/', k))")
    found = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("line"), F.col("p_brand").alias("mine"), F.expr("concat('https://a.example/', p_partkey)").alias("source_url"), F.concat(F.lit("="), "p_name").alias("title"), links.alias("links")
    )
    out = companions.links_table(found, "line", "links", ["mine"], 11)
    return out.select("line", "mine", "source_url", "title", "image_count", "method", "image_url_11", "description")


_PHOTO_1 = "case when photo = '' then 'https://cdn.example/p' || p_partkey || '-1.jpg' else photo end"


@query(f"""with {made.RECORDS} select p_partkey::varchar as row_key, 'https://a.example/' || p_partkey as source_url, {_PHOTO_1} as image_1, case when p_partkey % 3 = 0 then 'none' else 'hotlink' end as method,
 case when p_partkey % 6 = 0 then 'too_small' when p_partkey % 3 = 0 then 'below 400' else '' end as reason, 'a/1.jpg | a/2.jpg' as local_image_path from r""")
def images_table(spark, sf_dir):
    return companions.images_table(_told(spark, sf_dir)).select("row_key", "source_url", "image_1", "method", "reason", "local_image_path")


@query("""select p_partkey::varchar as row_key, k as image_order, 'a/' || k || '.jpg' as local_path, case when p_partkey % 3 = 0 then 'none' else 'hotlink' end as method,
 case when p_partkey % 6 = 0 then 'too_small' when p_partkey % 3 = 0 then 'below 400' else '' end as reason, (case k when 1 then p_size else 9 end)::bigint as bytes from part, (values (1), (2)) v(k)""")
def manifest_table(spark, sf_dir):
    return companions.manifest_table(_told(spark, sf_dir)).select("row_key", "image_order", "local_path", "method", "reason", "bytes")
