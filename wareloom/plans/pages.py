"""Queries over product pages that are written from ``part``, so that SQL over ``part`` says what must be read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareloom.functions import texts, values
from wareloom.operators import diagnosis, extract, intake
from wareloom.plans.registry import dealt, query, table
from wareloom.sources import links, page_evidence

_CENTS = "cast(round(p_retailprice * 100) as bigint)"
_PRICE = f"concat(cast({_CENTS} div 100 as string), '.', lpad(cast({_CENTS} % 100 as string), 2, '0'))"
_TOLD = "concat('Made of ', p_type, ' by ', p_brand, ' for everyday use at home')"
#: Parts with an even key have a product in JSON; which of its fields are there, and what else the page says, goes by the key.
_JSON = f"""if(p_partkey % 2 = 0, concat('<script type="application/ld+json">{{"@graph":[{{"@type":"BreadcrumbList","itemListElement":[{{"name":"Home"}},{{"item":{{"name":"', p_type, '"}}}}]}},',
 '{{"@type":["Thing","Product"],"sku":', p_partkey, if(p_partkey % 4 = 0, concat(',"name":"', p_name, ' No ', p_partkey, '"'), ''),
 if(p_partkey % 6 = 0, concat(',"description":"', {_TOLD}, '"'), ''), if(p_partkey % 8 = 0, concat(',"weight":{{"value":', p_size, ',"unitCode":"KGM"}}'), ''),
 if(p_partkey % 10 = 0, concat(',"offers":[{{"availability":"https://schema.org/', element_at(array('InStock', 'SoldOut', 'PreOrder'), cast(p_size % 3 as int) + 1), '"}},{{"price":"', {_PRICE}, '","priceCurrency":"inr","inventoryLevel":{{"value":', p_size, '}}}}]'), ''),
 if(p_partkey % 12 = 0, ',"hasVariant":[{{"size":"s"}},{{"size":"M"}},{{"size":"Select size"}},{{"name":"m"}}]', ''), ',"category":"All > ', p_brand, '"',
 ',"image":["/full/', p_partkey, '.jpg",{{"url":"//cdn.example/', p_partkey, '-2.jpg?utm_source=x&v=1"}}]}}]}}</script>'), '')"""
_HEAD = f"""concat('<!DOCTYPE html><html><head><title>', p_name, ' by ', p_brand, ' in ', p_type, ' ', p_partkey, ' | Best Shop</title>',
 if(p_partkey % 3 = 0, concat('<meta property="og:title" content="', upper(p_name), ' OF THE HOUSE ', p_partkey, '">'), ''),
 if(p_partkey % 5 = 0, concat('<meta name="description" content="', {_TOLD}, ', always"><meta property="product:price:amount" content="Rs. ', {_PRICE}, '"><meta property="product:price:currency" content="usd">'), ''), '</head>')"""
_BODY = f"""concat('<body>', if(p_partkey % 7 = 0, concat('<h1>', p_name, ' <i>here</i></h1>'), ''), '<div class="description">', {_TOLD}, '<br>Add to cart<br>and more</div>',
 '<span class="price">', element_at(array('$', '€', 'Rs ', ''), cast(p_partkey % 4 as int) + 1), {_PRICE}, '</span><table><tr><th>', if(p_partkey % 3 = 1, 'Shipping weight', 'Item Weight:'), '<td>', p_size / 2, ' lb',
 if(p_partkey % 4 = 1, concat('<tr><th>Dimensions<td>', p_size, ' x ', p_size + 1, ' x ', p_size + 2, ' in'), ''), '</table><ul>', if(p_partkey % 4 = 2, concat('<li>Size: H', p_size, ' x W2 x D1.5 cm'), ''),
 if(p_partkey % 3 = 0, concat('<li>Overall length: ', p_size, ' mm<li>Depth: 2 m'), ''), '</ul><p>', if(p_partkey % 9 = 0, concat(p_size, ' left'), 'ask'), '</p>',
 '<p class="stock">', element_at(array('In stock', 'sold out', 'Made to order', ''), cast(p_size % 4 as int) + 1), '</p>',
 '<select name="pick-size"><option>Select<option value="xl">big<option>XL<option>38</select>',
 '<img srcset="/s/files/', p_partkey, '_400x400.jpg 400w, /s/files/', p_partkey, '_900x.jpg 900w" src="../img/', replace(p_name, ' ', '-'), '.jpg" data-src="/icons/no.png"><div style="background-image: url(#x)"></div></body></html>')"""


def _written(spark, sf_dir):
    url = F.expr("concat('https://shop.example/products/', replace(p_name, ' ', '-'), '/', p_partkey)")
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), url.alias("url"), F.expr(f"concat({_HEAD}, {_JSON}, {_BODY})").alias("html"))


def _evidence(spark, sf_dir, *cells):
    return page_evidence.read_pages(_written(spark, sf_dir), columns=[c for cell in cells for c in extract.NEEDS[cell]], spread=False)


_SQL_CENTS = "cast(round(p_retailprice * 100) as bigint)"
_SQL_PRICE = f"(cast({_SQL_CENTS} // 100 as varchar) || '.' || lpad(cast({_SQL_CENTS} % 100 as varchar), 2, '0'))"
_SQL_TOLD = "('Made of ' || p_type || ' by ' || p_brand || ' for everyday use at home')"
#: Every word of a name and of the rest of the shouted title in title case.
_SQL_TITLE = "array_to_string(list_transform(string_split(lower(p_name) || ' of the house ' || p_partkey, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(f"""select p_partkey as page_id, case when p_partkey % 4 = 0 then p_name || ' No ' || p_partkey when p_partkey % 3 = 0 then {_SQL_TITLE}
 when p_partkey % 7 = 0 then p_name || 'here' else p_name || ' by ' || p_brand || ' in ' || p_type || ' ' || p_partkey end as title,
 case when p_partkey % 4 = 0 then 'high' when p_partkey % 3 = 0 then 'medium' when p_partkey % 7 = 0 then 'medium' else 'low' end as confidence,
 case when p_partkey % 4 = 0 then 'json-ld' when p_partkey % 3 = 0 then 'og' when p_partkey % 7 = 0 then 'h1' else 'title_tag' end as source from part""")
def product_title(spark, sf_dir):
    cell = extract.title()
    return _evidence(spark, sf_dir, "title").select("page_id", cell["value"].alias("title"), cell["confidence"].alias("confidence"), cell["source"].alias("source"))


@query(f"""select p_partkey as page_id, case when p_partkey % 6 = 0 then {_SQL_TOLD} when p_partkey % 5 = 0 then {_SQL_TOLD} || ', always' else {_SQL_TOLD} || chr(10) || 'and more' end as description,
 case when p_partkey % 6 = 0 then 'high' when p_partkey % 5 = 0 then 'medium' else 'low' end as confidence from part""")
def product_description(spark, sf_dir):
    cell = extract.description()
    return _evidence(spark, sf_dir, "description").select("page_id", cell["value"].alias("description"), cell["confidence"].alias("confidence"))


@query("""with p as (select p_partkey as page_id, p_size, p_partkey % 3 as t, p_partkey % 4 as f, p_partkey % 8 = 0 as own from part)
 select page_id, case when own and p_size > 0 then p_size * 1000 when p_size > 0 then round_even(p_size / 2.0 * 453.592, 0)::int end as weight_g,
 case when p_size is null or p_size <= 0 then 'none' when own then 'high' when t = 1 then 'low' else 'high' end as confidence,
 case when t = 0 then round_even(p_size * 0.1, 0)::int when f = 1 then round_even(p_size * 2.54, 0)::int when f = 2 then 2 end as length_cm,
 case when f = 1 then round_even((p_size + 1) * 2.54, 0)::int when f = 2 then 2 end as width_cm,
 case when t = 0 then 200 when f = 1 then round_even((p_size + 2) * 2.54, 0)::int when f = 2 then p_size end as height_cm from p""")
def product_measures(spark, sf_dir):
    weight = extract.weight()
    sides = [c["value"].alias(n) for c, n in zip(extract.axes(), ("length_cm", "width_cm", "height_cm"), strict=True)]
    return _evidence(spark, sf_dir, "weight", "axes").select("page_id", weight["value"].alias("weight_g"), weight["confidence"].alias("confidence"), *sides)


@query(f"""select p_partkey as page_id, {_SQL_PRICE}::double as amount, case when p_partkey % 10 = 0 then 'INR' when p_partkey % 5 = 0 then 'USD'
 when p_partkey % 4 = 0 then 'USD' when p_partkey % 4 = 1 then 'EUR' when p_partkey % 4 = 2 then 'INR' end as currency, p_partkey % 5 <> 0 and p_partkey % 4 = 0 as ambiguous from part""")
def product_price(spark, sf_dir):
    price = extract.price()
    return _evidence(spark, sf_dir, "price").select("page_id", *[price[c].alias(c) for c in ("amount", "currency", "ambiguous")])


@query("""with p as (select *, case when p_partkey % 10 = 0 then ['instock', 'soldout', 'preorder'][p_size % 3 + 1] else ['instock', 'soldout', 'preorder', ''][p_size % 4 + 1] end as state from part)
 select p_partkey as page_id, case when p_partkey % 12 = 0 then 'S,M' else 'XL,38' end as sizes, case when state = 'instock' then 'in_stock' end as availability,
 case state when 'soldout' then 'out of stock' when 'preorder' then 'made to order' when '' then 'no availability' end as note,
 case when p_partkey % 10 = 0 then p_size when p_partkey % 9 = 0 then p_size end as stock_qty from p""")
def product_variants(spark, sf_dir):
    state = extract.availability()
    return _evidence(spark, sf_dir, "sizes", "availability", "stock").select(
        "page_id", extract.sizes()["value"].alias("sizes"), state["value"].alias("availability"), state["note"].alias("note"), extract.stock()["value"].alias("stock_qty")
    )


@query("""select p_partkey as page_id, case when p_partkey % 2 = 0 then p_type || ' > ' || p_brand else '' end as trail, case when p_partkey % 2 = 0 then 'json-ld' end as source from part""")
def product_trail(spark, sf_dir):
    return _evidence(spark, sf_dir, "trail").select("page_id", F.array_join("trail", " > ").alias("trail"), F.col("product_source").alias("source"))


_SHOP = "'https://shop.example'"
_LINKS = f"""with l as (
 select p_partkey as page_id, 0 as place, 'structured' as rule, {_SHOP} || '/full/' || p_partkey || '.jpg' as url from part where p_partkey % 2 = 0
 union all select p_partkey, 1, 'structured', 'https://cdn.example/' || p_partkey || '-2.jpg?v=1' from part where p_partkey % 2 = 0
 union all select p_partkey, 2, 'srcset', {_SHOP} || '/s/files/' || p_partkey || '_400x400.jpg' from part
 union all select p_partkey, 3, 'srcset', {_SHOP} || '/s/files/' || p_partkey || '_900x.jpg' from part
 union all select p_partkey, 4, 'src', {_SHOP} || '/products/img/' || replace(p_name, ' ', '-') || '.jpg' from part)"""


@query(f"{_LINKS} select page_id, rule, url, row_number() over (partition by page_id order by place) as nth from l")
def photo_candidates(spark, sf_dir):
    found = extract.candidates(_evidence(spark, sf_dir, "candidates"))
    # the n-th picture of a page, by how many of its pictures stand before
    places = found.groupBy("page_id").agg(F.array_sort(F.collect_list("dom_index")).alias("places"))
    nth = F.array_position("places", F.col("dom_index")).cast("long")
    return found.join(places, "page_id").select("page_id", "rule", "url", nth.alias("nth"))


@query(f"""{_LINKS}, g as (select page_id, place, url, case when place in (2, 3) then {_SHOP} || '/s/files/' || page_id || '.jpg' else url end as photo from l)
 select page_id, case when photo like '%/s/files/%' then 0 when place = 4 then 1 else 2 + place end as photo_rank, 0 as rank, photo as url, photo like '%/s/files/%' as upsized from (select distinct page_id, photo, min(place) as place from g group by all)
 union all select page_id, 0, 1, url, false from g where place = 3""")
def photo_order(spark, sf_dir):
    return extract.ordered(extract.candidates(_evidence(spark, sf_dir, "candidates")))


# ---------------------------------------------------------------- text


@query("""with n as (select p_partkey, p_name || ' ' || p_type || ' set' as name, p_partkey % 5 as k from part),
 s as (select p_partkey, name, case k when 0 then name || ' | 70H Playtime | ' || 'BT v5.3' when 1 then name || ' - free Shipping' when 2 then upper(name) when 3 then name || ' – x – y Free Delivery' else name end as raw, k from n)
 select p_partkey, case when k = 2 then array_to_string(list_transform(string_split(lower(name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') else name end as title,
 case k when 0 then '70H Playtime, BT v5.3' when 3 then 'x, y Free Delivery' else '' end as tail from s""")
def title_names(spark, sf_dir):
    name = "concat(p_name, ' ', p_type, ' set')"
    raw = F.expr(
        f"case p_partkey % 5 when 0 then concat({name}, ' | 70H Playtime | ', 'BT v5.3') when 1 then concat({name}, ' - free Shipping') when 2 then upper({name})"
        f" when 3 then concat({name}, ' – x – y Free Delivery') else {name} end"
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", texts.tidied(F.col("raw")).alias("title"), F.array_join(texts.name_and_tail(F.col("raw"))["tail"], ", ").alias("tail"))


_FURNITURE = "|".join(texts.BOILERPLATE)


@query(f"""with w as (select doc_id, text, trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(
   regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\x0d\\x0a?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))),
   lambda x: not regexp_matches(lower(x), '{_FURNITURE}')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') as whole from documents),
 c as (select *, left(whole, {texts.DESCRIPTION_CHARS}) as head from w)
 select doc_id, case when length(whole) <= {texts.DESCRIPTION_CHARS} then whole else regexp_replace(coalesce(nullif(regexp_replace(head, '[ ][^ ]*$', ''), ''), head), '[ ,;-]+$', '') || '…' end as plain,
 length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 8 and length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) > length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) * 0.6 as shouts
 from c""")
def text_cleaning(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.clean_description(F.col("text")).alias("plain"), texts.shouty(F.col("text")).alias("shouts"))


@query("""select page_id, url, 'https://a.example/b/' || page_id || '.jpg' as relative, 'https://a.example/' || page_id as rooted, split_part(url, ':', 1) || '://c.example/' || page_id as bare,
 null::varchar as none, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '[a-z0-9]{3,}'), lambda t: t not in ('products', 'product', 'item', 'items', 'shop', 'buy', 'dp', 'collections')))), ' ') as words,
 case when page_id < 1024 then page_id || ' B' when page_id < 1048576 then printf('%.1f KB', page_id / 1024.0) end as size from pages""")
def page_links(spark, sf_dir):
    key, a = F.col("page_id").cast("string"), F.lit("https://a.example/b/c/page?x=1")
    link = lambda base, *parts: texts.absolute(base, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", link(a, "../", key, ".jpg").alias("relative"), link(a, "/x/../", key).alias("rooted"), link(F.col("url"), "//c.example/", key).alias("bare"),
        link(F.col("url"), "data:image/png;base64,", key).alias("none"), F.array_join(F.array_sort(texts.slug_tokens(F.col("url"))), " ").alias("words"), values.human_bytes(F.col("page_id")).alias("size"),
    )


# ---------------------------------------------------------------- pastes

#: A paste per page: markup, two links that touch, a bare domain, a file's name, prose, and a line that has no link.
_PASTE = """concat('see [shop.example/x](', url, '), thanks.\n', url, ',https://b.example/(', page_id, ').\t<a href="https://c.example/', page_id, '">here</a>; readme.md\n',
 'www.d', page_id, '.example/p?a=1,2 and half/way | plain words\n', if(page_id % 2 = 0, 'just, words;;--', 'htps:/typo.example\u200b'), '\n(e.example), Ｆ.example')"""


@query("""with u as (select page_id, url, page_id::varchar as k from pages)
 select page_id, 1 as line_no, 0 as pos, 'link' as kind, url as text from u union all select page_id, 1, 0, 'unparsed', 'thanks.' from u union all select page_id, 2, 0, 'link', url from u
 union all select page_id, 2, 1, 'link', 'https://b.example/(' || k || ')' from u union all select page_id, 2, 2, 'link', 'https://c.example/' || k from u
 union all select page_id, 2, 0, 'unparsed', '<a' || repeat(' ', 3 + length('https://c.example/' || k)) || '>here</a>' from u union all select page_id, 2, 1, 'unparsed', 'readme.md' from u union all select page_id, 3, 0, 'domain', 'https://www.d' || k || '.example/p?a=1,2' from u
 union all select page_id, 3, 0, 'unparsed', 'and half/way' from u union all select page_id, 4, n, 'unparsed', w from u, (values (0, 'just'), (1, 'words')) v(n, w) where page_id % 2 = 0
 union all select page_id, 4, 0, 'unparsed', 'htps:/typo.example' from u where page_id % 2 = 1
 union all select page_id, 5, 0, 'domain', 'https://e.example' from u union all select page_id, 5, 1, 'domain', 'https://F.example' from u""")
def pasted_links(spark, sf_dir):
    pastes = table(spark, sf_dir, "pages").select("page_id", F.expr(_PASTE).alias("paste"))
    return links.scan_texts(pastes, "page_id", "paste")


# ---------------------------------------------------------------- diagnosis

#: Every picture of a page, and whether its link has a word of the page's path: the name's words, or a key of three digits.
_TRACED = f"""t as (select page_id, place as dom, rule, url, place = 4 or length(page_id::varchar) >= 3 as own from ({_LINKS} select * from l)
 union all select p_partkey, 5, 'lazy', null, false from part union all select p_partkey, 6, 'background', null, false from part),
 d as (select page_id, rule, row_number() over (partition by page_id order by dom)::int - 1 as dom_index,
 case rule when 'lazy' then 'furniture' when 'background' then 'no link' else case when own then null else 'another product''s' end end as dropped from t)"""


@query(f"with {_TRACED} select page_id, dom_index, rule, dropped from d")
def photo_provenance(spark, sf_dir):
    return diagnosis.provenance(_evidence(spark, sf_dir, "candidates")).select("page_id", "dom_index", "rule", "dropped")


@query(f"""{_LINKS} select page_id, rule, url from l where place = 4 or length(page_id::varchar) >= 3""")
def products_own_photos(spark, sf_dir):
    return diagnosis.products_own(extract.candidates(_evidence(spark, sf_dir, "candidates"))).select("page_id", "rule", "url")


@query(f"""with {_TRACED}, p as (select p_partkey as page_id, p_partkey % 5 as k from part),
 n as (select page_id, count(*) as found, count(*) filter (dropped is null) as kept, count(*) filter (rule = 'structured') as structured, count(*) filter (dropped = 'another product''s') as others from d group by 1)
 select p.page_id, case when k = 0 then 'no' else 'yes' end as arrived, case k when 0 then 'not reached' when 1 then 'yes' else 'no' end as bot_check,
 case when k in (0, 1) then 'not reached' when k = 2 then 'yes' else 'no' end as sign_in, case when k in (0, 1, 2) then 'not reached' else 'no' end as gone,
 case k when 1 then 'bot_challenge' when 2 then 'sign_in_required' end as verdict, case when k = 0 then 'not reached' when k in (1, 2) then 'no' else 'yes' end as collected,
 case when k > 2 then found end as found, case when k > 2 then kept end as kept, case when k > 2 then structured end as structured, case when k > 2 then others end as others from p join n using (page_id)""")
def page_reports(spark, sf_dir):
    html = F.expr("case page_id % 5 when 1 then 'Robot Check' when 2 then 'Please sign in: Members Only' when 0 then null else 'plain' end")
    trace = diagnosis.provenance(_evidence(spark, sf_dir, "candidates"))
    out = diagnosis.reports(_written(spark, sf_dir).select("page_id", "url", html.alias("html")), trace, F.lit(""), F.lit(False))
    count = lambda name, column, value: F.get(F.filter(f"images.{column}", lambda x: x[name] == value), F.lit(0))["n"]
    return out.select(
        "page_id", *[F.col(f"shape.{c}") for c in ("arrived", "bot_check", "sign_in", "gone", "verdict")], "images.collected", "images.found", "images.kept",
        count("rule", "by_rule", "structured").alias("structured"), count("reason", "by_drop", "another product's").alias("others"),
    )


@query("""select page_id, 6::bigint as accepted, 1::bigint as duplicates, (case when page_id % 2 = 0 then 6 else 5 end)::bigint as unparsed, url as first_link, 'thanks.' as first_left, false as truncated from pages""")
def paste_previews(spark, sf_dir):
    pastes = table(spark, sf_dir, "pages").select("page_id", F.expr(_PASTE).alias("paste"))
    out = intake.previews(links.scan_texts(pastes, "page_id", "paste"), "page_id")
    return out.select("page_id", "accepted", "duplicates", "unparsed", F.get("links", F.lit(0))["text"].alias("first_link"), F.get("leftovers", F.lit(0))["text"].alias("first_left"), "truncated")
