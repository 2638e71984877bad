"""Queries over listing records that are made from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareloom.functions import texts, urls, values
from wareloom.operators import enrich, findings, records
from wareloom.plans import registry
from wareloom.plans.registry import query, table
from wareloom.sources import exports

#: (cell, value, confidence) of each part's record, in SQL that both engines read; parts by 23 have nothing in them.
_CELLS = (
    ("title", "case when p_partkey % 11 = 0 then null when p_partkey % 7 = 0 then concat('=', p_name) else p_name end", "case p_partkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end"),
    ("description", "concat(p_type, ', \"', p_brand, '\"')", "'high'"),
    ("category_slug", "case when p_partkey % 3 <> 0 then 'apparel' end", "'medium'"),
    ("price_inr", "case when p_partkey % 5 <> 0 then p_size * 10 end", "'high'"),
    ("weight_g", "case when p_partkey % 4 <> 0 then p_size end", "'low'"),
    ("length_cm", "case when p_partkey % 2 = 0 then p_size end", "'high'"),
    ("width_cm", "case when p_partkey % 2 = 0 then 7 end", "'high'"),
    ("height_cm", "case when p_partkey % 2 = 0 then 2 end", "'none'"),
    ("sizes", "case when p_partkey % 2 = 0 then 'S,M' end", "'high'"),
)
_STATUS = "case when p_partkey % 19 = 0 then 'failed' when p_partkey % 17 = 0 then 'needs_review' else 'ok' end"
_PHOTO = "case when p_partkey % 3 = 0 then '' else concat('https://cdn.example/p', p_partkey, '-1_800x800.jpg') end"
_FILES = (
    "array(struct(concat('https://cdn.example/p', p_partkey, '-1.jpg') as hosted_url, 'https://x.example/1.jpg' as original_url, 'a/1.jpg' as local_path, cast(p_size as bigint) as bytes, p_size as width, 2 as height),"
    " struct('' as hosted_url, concat('https://x.example/', p_partkey, '.png') as original_url, 'a/2.jpg' as local_path, 9L as bytes, 3 as width, 4 as height))"
)


def part_records(spark, sf_dir):
    cells = [
        F.expr(f"named_struct('value', if(p_partkey % 23 = 0, null, {value}), 'confidence', {sure}, 'source', 'x', 'note', cast(null as string))").cast(records.CELL.format(records.kind_of(name))).alias(name)
        for name, value, sure in _CELLS
    ]
    made = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_partkey").cast("string").alias("row_key"), F.expr("concat('https://shop.example/', p_partkey)").alias("source_url"), *cells,
        F.expr(_STATUS).alias("status"), F.expr("if(p_partkey % 13 = 0, array('look'), cast(array() as array<string>))").alias("notes"),
        F.expr("if(p_partkey % 17 = 0, array('f1', 'f2'), cast(array() as array<string>))").alias("flags"), F.expr(_PHOTO).alias("image_url"),
        F.expr(_FILES).alias("files"), F.expr(f"array({_PHOTO}, 'https://x.example/other.jpg')").alias("image_candidates"),
    )
    return records.complete(made)


RECORDS = f"""r as (select p_partkey, p_partkey % 23 = 0 as bare, {_STATUS} as status, {_PHOTO} as photo, p_size, {', '.join(f'case when p_partkey % 23 <> 0 then {v} end as {n}, {s} as {n}_sure' for n, v, s in _CELLS)} from part)"""
_PRESENT = [n for n, _, _ in _CELLS]
_PICTURES = "case when photo = '' then concat('https://cdn.example/p', p_partkey, '-1.jpg') else photo end"


def _cell_sql(name: str) -> str:
    if name in _PRESENT:
        text = f"coalesce(cast({name} as varchar), '')"
        return f"case when regexp_matches({text}, '^[=+@-]') then '''' || {text} else {text} end"
    return _PICTURES if name == "image_urls" else "''"


def _quoted_sql(text: str) -> str:
    return f"case when regexp_matches({text}, '[\",\\r\\n]') then '\"' || replace({text}, '\"', '\"\"') || '\"' else {text} end"


@query(f"with {RECORDS} select p_partkey, {' || chr(44) || '.join(_quoted_sql(_cell_sql(c)) for c in records.COLUMNS)} as line from r where status <> 'failed'")
def listing_lines(spark, sf_dir):
    return records.listing_lines(part_records(spark, sf_dir), "p_partkey")


MISSING = ", ".join(f"case when {c} is null then '{c}' end" if c in _PRESENT else f"'{c}'" for c in records.REQUIRED)
UNSURE = ", ".join(f"case when {c} is not null and {c}_sure in ('low', 'medium') then '{c}:' || {c}_sure end" for c in _PRESENT)
_DEPTHS = " || ".join(
    f"case when {c} is null then '0' else case {c}_sure when 'high' then '3' when 'medium' then '2' when 'low' then '1' else '0' end end" if c in _PRESENT else "'-'" if c == "gi_region" else "'3'" if c == "image_urls" else "'0'"
    for c in records.COLUMNS
)


@query(f"""with {RECORDS} select p_partkey, status, case when p_partkey % 17 = 0 then 'f1 | f2' else '' end as flags, array_to_string(list_filter([{MISSING}], lambda x: x is not null), ' | ') as missing,
 array_to_string(list_filter([{UNSURE}], lambda x: x is not null), ' | ') as unsure, {_DEPTHS} as depths, case when p_partkey % 13 = 0 then 'look' else '' end as notes
 from r where status <> 'failed' and not bare""")
def review_rows(spark, sf_dir):
    return records.review_rows(part_records(spark, sf_dir), "p_partkey")


@query(f"""with {RECORDS} select p_partkey, coalesce(cast(price_inr as varchar), '') as price_inr, photo as image_url, case when photo = '' then 'https://cdn.example/p' || p_partkey || '-1.jpg' else photo end as image_1,
 'https://x.example/' || p_partkey || '.png' as image_2, '' as image_3, 2 as image_count, 'https://x.example/other.jpg' as rejected_image_urls, p_size as width from r""")
def listings_with_images(spark, sf_dir):
    wide = records.with_images(part_records(spark, sf_dir), "p_partkey")
    return wide.select("p_partkey", "price_inr", "image_url", "image_1", "image_2", "image_3", "image_count", "rejected_image_urls", F.col("width").cast("int").alias("width"))


@query("""select p_partkey, 1 as place, 'https://cdn.example/p' || p_partkey || '-1.jpg' as hosted_url, 'a/1.jpg' as local_path, p_size::bigint as bytes from part
 union all select p_partkey, 2, '', 'a/2.jpg', 9 from part""")
def image_manifest(spark, sf_dir):
    return records.manifest(part_records(spark, sf_dir), "p_partkey").select("p_partkey", "place", "hosted_url", "local_path", "bytes")


@query("""select p_partkey as line, '''-' || p_brand as mine, case when p_size % 12 >= 1 then 'https://a.example/' || p_partkey || '/1' else '' end as image_url_1,
 case when p_size % 12 >= 10 then 'https://a.example/' || p_partkey || '/10' else '' end as image_url_10, case when p_size % 12 >= 11 then 'https://a.example/' || p_partkey || '/11' else '' end as image_url_11 from part""")
def image_link_table(spark, sf_dir):
    links = F.expr("transform(slice(sequence(1, 12), 1, p_size % 12), k -> concat('https://a.example/', p_partkey, '/', k))")
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.expr("concat('-', p_brand)").alias("mine"), links.alias("links"))
    return records.image_links(found, "line", "links", ["mine"]).select("line", "mine", "image_url_1", "image_url_10", "image_url_11")


@query(f"""with {RECORDS} select p_partkey, case when title is null or title_sure = 'low' then 'second' else title end as title, case when title is not null and title_sure <> 'low' then title_sure when title is null then 'medium' else 'medium' end as title_sure,
 coalesce(price_inr, 5) as price_inr, case when bare or weight_g is null then 9 when weight_g_sure = 'low' then 9 else weight_g end as weight_g, status, p_partkey % 2 = 0 as pictures from r""")
def merged_rendering(spark, sf_dir):
    made = part_records(spark, sf_dir)
    cell = lambda v, sure, n: F.struct(F.lit(v).alias("value"), F.lit(sure).alias("confidence"), F.lit("y").alias("source"), F.lit(None).alias("note")).cast(records.CELL.format(records.kind_of(n))).alias(n)
    more = F.expr("if(p_partkey % 2 = 0, array('a', 'b', 'c'), array('a'))")
    # a second title is only surer than a low one; a price of low confidence fills gaps alone
    second = made.select("p_partkey", cell("second", "medium", "title"), cell(5, "low", "price_inr"), cell(9, "medium", "weight_g"), more.alias("image_candidates"))
    out = records.merge_rendered(made, second, "p_partkey")
    return out.select(
        "p_partkey", F.col("title")["value"].alias("title"), F.col("title")["confidence"].alias("title_sure"), F.col("price_inr")["value"].alias("price_inr"), F.col("weight_g")["value"].alias("weight_g"),
        "status", F.array_contains("gained", "pictures").alias("pictures"),
    )


@query(f"""with {RECORDS}, f as (select *, title is null as failed, description is null as nothing from r),
 s as (select *, case when failed then 'failed' when status = 'ok' and (nothing or title_sure = 'low') then 'needs_review' else status end as after from f)
 select p_partkey, case when after = 'ok' and p_partkey % 2 = 1 then 'needs_review' else after end as status, p_partkey % 2 = 1 and not nothing as verbatim,
 (case when p_partkey % 13 = 0 then 1 else 0 end + failed::int + (p_partkey % 2 = 1)::int)::bigint as notes from s""")
def gated_records(spark, sf_dir):
    theirs = records.flagged(part_records(spark, sf_dir)).withColumn("provenance", F.expr("if(p_partkey % 2 = 1, 'third_party', 'own')"))
    out = records.provenance_gate(theirs, raw_description=True)
    return out.select("p_partkey", "status", F.array_contains("flags", "description is verbatim").alias("verbatim"), F.size("notes").cast("long").alias("notes"))


@query(f"""with {RECORDS} select p_partkey, (case when p_partkey % 5 = 0 then 'ask me · ' else '' end) || 'Source: https://shop.example/' || p_partkey || case when weight_g is not null then ' · Weight: ' || weight_g || ' g' else '' end
 || case when length_cm is not null then ' · Size: ' || length_cm || ' x 7 x 2 cm · Options: S,M' else '' end || ' · Listed on source at ' || (p_size * 10) || ' USD' as note from r""")
def seller_notes(spark, sf_dir):
    made = part_records(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    note = records.seller_note(F.expr("if(p_partkey % 5 = 0, 'ask me', '')"), F.col("p_size") * 10.0, F.lit("USD"))
    return made.select("p_partkey", note.alias("note"))


#: (field, text of the edit, SQL of its fault): each is tried on every part.
_EDITS = (
    ("price_inr", "concat(p_size - 3, ' ')", "case when p_size < 3 then 'negative' when p_size = 3 then 'free' end"),
    ("stock_qty", "p_brand", "'not_a_number'"),
    ("category_slug", "case when p_partkey % 2 = 0 then 'apparel' else p_type end", "case when p_partkey % 2 = 1 then 'unknown_category' end"),
    ("subcategory_slug", "case when p_partkey % 2 = 0 then 'kids' else 'rings' end", "case when p_partkey % 2 = 1 then 'unknown_subcategory' end"),
    ("hs_code", "concat('000', p_size)", "case when p_size < 0 then 'bad_hs_code' end"),
    ("sizes", "concat('S, ', case when p_partkey % 3 = 0 then ',' else 'M' end)", "case when p_partkey % 3 = 0 then 'bad_sizes' end"),
    ("title", "case when p_partkey % 3 = 0 then ' ' else p_name end", "case when p_partkey % 3 = 0 then 'no_title' end"),
    ("gi_region", "p_name", "'locked'"),
    ("source_url", "p_name", "'unknown_field'"),
    ("availability", "case when p_partkey % 2 = 0 then 'in_stock' else 'soon' end", "case when p_partkey % 2 = 1 then 'unknown_availability' end"),
    ("rfq_enabled", "case when p_partkey % 2 = 0 then 'yes' else 'no' end", "case when p_partkey % 2 = 1 then 'not_yes_or_blank' end"),
)


@query(" union all ".join(f"select p_partkey, '{field}' as field, {fault} as fault from part" for field, _, fault in _EDITS))
def edit_faults(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    edits = F.array(*[F.struct(F.lit(field).alias("field"), F.expr(text).cast("string").alias("raw")) for field, text, _ in _EDITS])
    tried = part.select("p_partkey", F.explode(edits).alias("e")).select("p_partkey", "e.*")
    return tried.select("p_partkey", "field", records.edit_fault(F.col("field"), F.col("raw"), F.lit("apparel")).alias("fault"))


@query("""select p_partkey, case when p_partkey % 2 = 0 then 'no size' else 'no weight, no size' end as notes, (case when p_partkey % 2 = 0 then 1 else 2 end)::int as open from part""")
def retracted_gaps(spark, sf_dir):
    gaps = F.create_map(F.lit("weight_g"), F.lit("no weight"), F.lit("length_cm"), F.lit("no size"), F.lit("width_cm"), F.lit("no size"))
    filled = F.expr("if(p_partkey % 2 = 0, array('weight_g', 'length_cm'), array('width_cm'))")
    notes, left = records.retract_gaps(F.array(F.lit("no weight"), F.lit("no size")), gaps, filled)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(notes, ", ").alias("notes"), F.size(left).alias("open"))


# ---------------------------------------------------------------- links, keys, exports


@query("""with k as (select page_id, url, rtrim(ltrim(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-'), '-') as slug from pages)
 select page_id, case when length(slug) <= 60 then slug else substr(regexp_replace(substr(slug, 1, 61), '-[^-]*$', ''), 1, 60) end || '-' || substr(sha1(url), 1, 8) as key from k""")
def row_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.row_key(F.col("url")).alias("key"))


@query("""select p_partkey, case p_partkey % 4 when 0 then p_size * 37 + 100 when 1 then p_size * 11 + 10 when 2 then p_size + 50 end as width from part""")
def declared_widths(spark, sf_dir):
    link = F.expr(
        "case p_partkey % 4 when 0 then concat('https://a.example/x_', p_size * 37 + 100, 'x', p_size + 10, '.jpg') when 1 then concat('https://a.example/a.jpg?v=3&w=', p_size * 11 + 10)"
        " when 2 then concat('https://a.example/width-', p_size + 50, '/b.jpg') else concat('https://1200x900.example/c', p_size, '.jpg') end"
    )
    return table(spark, sf_dir, "part").select("p_partkey", urls.declared_width(link).alias("width"))


@query("""select p_partkey, case p_partkey % 4 when 0 then trunc(p_size * 1000) when 1 then trunc(p_size * 453.592) when 2 then trunc(p_size * 28.3495) else p_size end::bigint as grams from part""")
def export_weights(spark, sf_dir):
    text = F.expr("concat(p_size, element_at(array(' kg', ' lb', ' oz', ''), cast(p_partkey % 4 as int) + 1))")
    return table(spark, sf_dir, "part").select("p_partkey", exports.grams(text).alias("grams"))


@query("""with c as (select p_partkey, cast(round(p_retailprice * 100) as bigint) as cents from part), p as (select *, cast(cents // 100 as varchar) as w, lpad(cast(cents % 100 as varchar), 2, '0') as d from c)
 select p_partkey, case p_partkey % 6 when 0 then (w || '.' || d)::double when 1 then (w || '.' || d)::double when 2 then (w || '.' || d)::double when 3 then (w || '000')::double when 4 then (w || '000')::double end as amount,
 case p_partkey % 6 when 0 then 'INR' when 1 then 'EUR' when 2 then 'USD' when 3 then 'GBP' when 4 then 'AED' end as currency, p_partkey % 6 = 2 as ambiguous from p""")
def price_texts(spark, sf_dir):
    cents = "cast(round(p_retailprice * 100) as bigint)"
    w, d = f"cast({cents} div 100 as string)", f"lpad(cast({cents} % 100 as string), 2, '0')"
    text = F.expr(
        f"case p_partkey % 6 when 0 then concat('Rs. 1', ',') when 1 then concat({w}, ',', {d}, ' €') when 2 then concat('from $ ', {w}, '.', {d}, ' up') when 3 then concat('£', {w}, '.000')"
        f" when 4 then concat('AED ', {w}, ',000') else 'ask' end"
    )
    text = F.when(F.col("p_partkey") % 6 == 0, F.expr(f"concat('₹ ', {w}, '.', {d})")).otherwise(text)
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    return rows.select("p_partkey", values.amount(F.col("t")).alias("amount"), values.currency(F.col("t")).alias("currency"), values.ambiguous_currency(F.col("t")).alias("ambiguous"))


@query("""select p_partkey, 'https://a.example/x?key=***REDACTED***&q=' || p_size as log, 'https://m.media-amazon.com/images/I/' || p_partkey || '.jpg' as photo,
 case when p_partkey % 2 = 0 then 'https://cdn.shopify.com/s/files/' || p_partkey || '.jpg' end as original, p_type || p_size as data, '{"a": ' || p_size || '}' as reply from part""")
def link_texts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    shop = F.expr("concat('https://', if(p_partkey % 2 = 0, 'cdn.shopify.com', 'cdn.example'), '/s/', if(p_partkey % 2 = 0, 'files/', 'file/'), p_partkey, '_600x.jpg')")
    return part.select(
        "p_partkey", texts.redacted(F.expr("concat('https://a.example/x?key=', p_brand, '&q=', p_size)")).alias("log"),
        texts.without_size_modifier(F.expr("concat('https://m.media-amazon.com/images/I/', p_partkey, '._AC_SL1500_.jpg')")).alias("photo"), texts.full_size(shop).alias("original"),
        texts.data_uri(F.expr("concat('data:text/plain;base64,', base64(encode(concat(p_type, p_size), 'utf-8')))")).cast("string").alias("data"),
        texts.json_in(F.expr("concat('Here:\n```json\n{\"a\": ', p_size, '}\n```')")).alias("reply"),
    )


@query("""select page_id, case page_id % 4 when 0 then 'https://amazon.in/dp/B0' || lpad(page_id::varchar, 8, '0') when 1 then 'https://flipkart.com/a/p/itm' || page_id || '?pid=X' || page_id
 when 2 then 'https://etsy.com/listing/' || page_id else 'https://shop.example:8443/A/' || page_id || '?b=1,2' end as canonical from pages""")
def url_rules(spark, sf_dir):
    link = F.expr(
        "case page_id % 4 when 0 then concat('https://www.Amazon.in/some-thing/dp/b0', lpad(page_id, 8, '0'), '/ref=sr_1?tag=x#top') when 1 then concat('http', 's://www.flipkart.com/a/p/itm', page_id, '?lid=1&pid=X', page_id, '&q=2')"
        " when 2 then concat('https://www.etsy.com/in-en/listing/', page_id, '/slug?click=1') else concat('https://me@www.shop.example:8443/A/', page_id, '?utm_source=n&b=1,2&ref=z') end"
    )
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(link).alias("canonical"))


@query("""with r as (select p_partkey, case when p_partkey % 3 = 0 then null else p_name end as title, p_partkey % 2 = 0 as bare from part)
 select p_partkey, title is null as unnamed, case when bare then '' else 'yes' end as rfq, case when bare then null else 5 end as least from r""")
def policy_defaults(spark, sf_dir):
    made = records.complete(table(spark, sf_dir, "part").select(
        "p_partkey", F.expr("if(p_partkey % 3 = 0, null, p_name)").alias("name"), F.expr("p_partkey % 2 = 0").alias("bare"),
    ))
    filled = made.select("p_partkey", "name", "bare", *[c for c in records.defaults(rfq=~F.col("bare"), least=F.lit(5), bulk=F.lit(False))])
    return filled.select("p_partkey", F.col("name").isNull().alias("unnamed"), F.coalesce(F.col("rfq_enabled")["value"], F.lit("")).alias("rfq"), F.col("rfq_min_qty")["value"].alias("least"))


# ---------------------------------------------------------------- stated values, second readings, checks as data

_STATED = "case p_partkey % 4 when 0 then 'jewellery' when 1 then ' apparel' when 2 then 'Shoes' else '' end"


@query(f"""{registry.CATEGORY}, h as (select g.*, trim({_STATED}) as stated, case when p_partkey % 5 = 0 then '7113' end as code from g)
 select p_partkey, case when stated in ('jewellery', 'apparel') then stated else category_slug end as category_slug,
 case when stated not in ('jewellery', 'apparel') or stated = category_slug then subcategory_slug end as subcategory_slug, case when stated not in ('jewellery', 'apparel') then custom_category end as custom_category, code as hs_code,
 case when stated in ('jewellery', 'apparel') and stated <> category_slug then 'kept the stated category ' || stated || ', derived ' || category_slug
  when stated = 'Shoes' then 'stated category Shoes is unknown, filed under ' || category_slug else '' end as said from h""")
def stated_categories(spark, sf_dir):
    derived = registry.classified(spark, sf_dir).withColumn("hs_code", F.lit(None).cast("string"))
    out = enrich.with_stated(derived, F.expr(_STATED), F.expr("case when p_partkey % 5 = 0 then '7113' end"))
    return out.select("p_partkey", "category_slug", "subcategory_slug", "custom_category", "hs_code", F.array_join("said", "; ").alias("said"))


@query("""select p_partkey, case when p_partkey % 3 < 2 then 'ok' else 'needs_review' end as status, case when p_partkey % 3 = 0 then p_size end as weight_g,
 case p_partkey % 3 when 0 then 'told | no sizes | no weight; rendering recovered weight_g' when 1 then 'told | no weight | no weight; rendering found nothing more'
  else 'told | no weight | no sizes | no weight; rendering failed, the first reading stands' end as notes,
 case p_partkey % 3 when 0 then 'sizes' else 'sizes,weight_g' end as gaps from part""")
def second_readings(spark, sf_dir):
    cell = lambda v, sure, n: F.struct(v.alias("value"), F.lit(sure).alias("confidence"), F.lit("y").alias("source"), F.lit(None).alias("note")).cast(records.CELL.format(records.kind_of(n))).alias(n)
    part = table(spark, sf_dir, "part")
    first = part.select(
        "p_partkey", F.lit("needs_review").alias("status"), cell(F.col("p_name"), "high", "title"), F.array(*map(F.lit, ("told", "no weight", "no sizes"))).alias("notes"), F.lit(1).alias("notes_before"),
        F.lit("ok").alias("status_before"), F.create_map(F.lit("weight_g"), F.lit("no weight"), F.lit("sizes"), F.lit("no sizes")).alias("gap_notes"),
    )
    weight = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size"))
    notes = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("no sizes"))).otherwise(F.array(F.lit("no weight")))
    again = part.where("p_partkey % 3 < 2").select("p_partkey", F.lit("ok").alias("status"), cell(weight, "high", "weight_g"), notes.alias("notes"))
    out = records.rendered_again(first, again, F.lit("weight"), "p_partkey")
    gaps = F.array_join(F.array_sort(F.map_keys("gap_notes")), ",")
    return out.select("p_partkey", "status", F.col("weight_g.value").alias("weight_g"), F.array_join("notes", " | ").alias("notes"), gaps.alias("gaps"))


#: (table, level, title, fault, most, needed, fix); the faults are read by both engines.
_RULES = (
    ("part", "fail", "parts have prices", "p_retailprice is null or p_retailprice <= 0", 0, 1, "set a price"),
    ("part", "warn", "sizes are small", "p_size > 45", 10, 0, "check the sizes"),
    ("part", "warn", "names are told apart", "p_name = p_type", 0, 10_000_000, "load more parts"),
    ("customer", "warn", "no debts", "c_acctbal < 0", 5, 0, "ask for payment"),
    ("customer", "fail", "segments are named", "c_mktsegment is null", 0, 1, "name the segment"),
    ("stock", "fail", "stock is there", "true", 0, 1, "load the stock"),
)


def _finding_sql(rule: tuple) -> str:
    name, level, title, fault, most, needed, fix = rule
    if name not in ("part", "customer"):
        return f"select 'fail' as level, '{title}' as title, 'no table {name}' as detail, '{fix}' as fix"
    key = {"part": "p_partkey", "customer": "c_custkey"}[name]
    return f"""select case when n < {needed} or bad > {most} then '{level}' else 'ok' end, '{title}', case when n < {needed} then n || ' rows, {needed} needed'
 else bad || ' of ' || n || ' rows' || coalesce(', first ' || first, '') end, case when n < {needed} or bad > {most} then '{fix}' end
 from (select count(*) as n, count(*) filter ({fault}) as bad, min({key}::varchar) filter ({fault}) as first from {name})"""


@query(" union all ".join(map(_finding_sql, sorted(_RULES, key=lambda r: r[0] != "stock"))))
def data_findings(spark, sf_dir):
    tables = {n: table(spark, sf_dir, n) for n in ("part", "customer")}
    return findings.evaluate(tables, spark.createDataFrame(_RULES, findings.CONSTRAINTS), {"part": "p_partkey", "customer": "c_custkey"})
