"""More queries over the driver's tables: the search path, repositories, views, downloads, rules and clocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as S, times as T
from ..operators import export as E, harvest as H, records as V, relational as R
from . import execute as X, fields as U
from .catalog import BLOCKS, blocks, query, table
from .request import SearchRequest

# --- one search path

PARTS = "d as (select p_partkey id, p_name, string_split(p_name, ' ') nw, [lower(p_type)] tw, p_brand from part)"
RANKED = f"""{PARTS}, v as (select unnest(['small', 'ring']) t),
 a as (select id, 'name' f, len(nw) n, t, len(list_filter(nw, lambda w: w = t)) tf from d, v union all select id, 'type', len(tw), t, len(list_filter(tw, lambda w: w = t)) from d, v),
 h as (select * from a where tf > 0), s as (select 'name' f, count(*) docs, avg(len(nw)) mean from d union all select 'type', count(*), avg(len(tw)) from d),
 k as (select f, t, count(*) df from h group by all),
 w as (select id, t, case f when 'name' then 100.0 else 10.0 end * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) w from h join s using (f) join k using (f, t)),
 b as (select id, t, max(w) + 0.01 * (sum(w) - max(w)) w from w group by all),
 r as (select id, sum(w) + case when list_has_all(any_value(nw), ['small', 'ring']) then 200.0 else 0.0 end score, count(*) n_terms from b join d using (id) where p_brand not in ('Brand#2', 'Brand#4') group by id having count(*) >= 2)"""
REQUEST = SearchRequest(q="small rings", qf={"name": 100, "type": 10}, pf={"name": 200}, filters={"-brand": ["Brand#2", "Brand#4"]}, group="false", per_page=20)


def parts(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array("p_name").alias("name"), F.array("p_type").alias("type"), F.array("p_brand").alias("brand"))


def searched(spark, sf, request=REQUEST):
    return X.search(parts(spark, sf), request, ["brand", "type"], "name", names={"brand": "brand"})


@query(f"with {RANKED} select id, round(score, 6) score, n_terms from r")
def q1_ranked(spark, sf):
    return searched(spark, sf).ranked.select("id", F.round("score", 6).alias("score"), "n_terms")


@query(f"with {RANKED} select id, round(score, 6) score, regexp_replace(p_name, '\\b(small|rings?)\\b', '<em>\\1</em>', 'g') highlight from r join d using (id) order by r.score desc, id limit 20")
def q12_highlighted_page(spark, sf):
    rows = X.search(parts(spark, sf), SearchRequest(**{**REQUEST.__dict__, "q": "small ring"}), None, "name", names={"brand": "brand"}).hits
    return rows.select("id", F.round("score", 6).alias("score"), "highlight")


@query(f"with {RANKED}, c as (select 'brand' field, p_brand \"value\", count(*) \"count\" from r join part on id = p_partkey group by 2 union all select 'type', p_type, count(*) from r join part on id = p_partkey group by 2) select field, \"value\", \"count\", place::int place from (select *, row_number() over (partition by field order by \"count\" desc, \"value\") place from c) where place <= 11")
def q1_facets(spark, sf):
    return searched(spark, sf).facets


@query("select p_partkey id, 1.0::double score from part where p_brand != 'Brand#2'")
def s13_match_all(spark, sf):
    return X.search(parts(spark, sf), SearchRequest(filters={"-brand": ["Brand#2"]}, group="false"), names={"brand": "brand"}).ranked.select("id", "score")


@query("select count(*) hits from part where (p_name like '%small%' or p_type = 'SMALL') and p_name not like '%ring%'")
def q8_search_boolean(spark, sf):
    return X.search(parts(spark, sf), SearchRequest(q="small AND -rings", qf={"name": 1, "type": 1}, pf={}, group="false")).total


@query("select min(o_orderkey) id from orders where o_custkey = (select min(o_custkey) from orders) having count(*) > 0")
def q19_resolve_ark(spark, sf):
    href = F.concat(F.lit("ark:/12345/c8"), F.md5(F.col("o_custkey").cast("string")))
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.hyphenate_ark(href).alias("ark_id_ssi"), "o_custkey")
    first = docs.agg(F.min("o_custkey").alias("least"))
    asked = F.concat(F.lit("ark:/12345/c8"), F.md5(F.col("least").cast("string")))
    return X.resolve(docs.join(F.broadcast(first)), asked)  # one row


# --- repositories and scans


@query("select lower(n_name) code, '/repositories/' || n_nationkey uri, case when n_nationkey % 2 = 0 then 'c' || n_nationkey end ark_shoulder, null::varchar \"key\" from nation")
def s7_repositories(spark, sf):
    record = F.struct(F.col("n_name").alias("repo_code"), F.concat(F.lit("/repositories/"), "n_nationkey").alias("uri"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("c"), "n_nationkey")).alias("ark_shoulder"))
    bodies = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(record)).alias("body"))
    return V.repository_rows(bodies)


def repositories(spark, sf):
    return table(spark, sf, "nation").select(F.lower("n_name").alias("code"), F.concat(F.lit("set"), "n_regionkey").alias("config_set"), F.concat(F.lit("/repositories/"), "n_nationkey").alias("uri"))


@query("select lower(n_name) code, '/repositories/' || n_nationkey uri from nation where n_regionkey in (1, 2) and n_nationkey % 3 = 0")
def p20_harvestable(spark, sf):
    listed = table(spark, sf, "nation").where("n_regionkey in (1, 2) and n_nationkey % 3 = 0").select(F.concat(F.lit("set"), "n_regionkey").alias("config_set"), F.lower("n_name").alias("code"))
    return V.harvestable(repositories(spark, sf), listed).select("code", "uri")


@query("select '/repositories/' || n_nationkey uri from nation where lower(n_name) = 'nation_7' and n_regionkey = 2 order by 1 limit 1")
def p21_find_repository(spark, sf):
    return V.find_repository(repositories(spark, sf), "nation_7", "set2").select("uri")


@query("select o_orderkey, o_totalprice from orders where o_orderkey > 500 order by 1 limit 250")
def s11_next_page(spark, sf):
    return V.scan_after(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 250)


@query("select (o_orderkey // 1000)::bigint batch, count(*) n, min(o_orderkey) first from orders group by 1")
def s15_batches(spark, sf):
    return V.batch_number(table(spark, sf, "orders"), "o_orderkey", 1000).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("select p_partkey, case when p_size % 3 != 0 then p_name end first from part")
def g11_first_of_each(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.first_of_each(F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name", "p_brand"))).alias("first"))


@query("select o_orderkey uri from orders where o_orderdate::date > date '1997-06-01' - 2")
def w2_overlap(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("uri"), "o_orderdate")
    return rows.where(F.to_date("o_orderdate") > H.updated_since(F.lit("1997-06-01"))).select("uri")


# --- views


@query("select o_orderkey, count(l_linenumber) > 4 or count(l_linenumber) > 0 has_components from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def p24_has_components(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", V.has_components(F.col("n")).alias("has_components"))


def links(spark, sf):
    one = lambda label, href: F.struct(F.lit(label).alias("label"), href.alias("href"))
    purl = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://purl.example.org/ab123cd"), F.lpad(F.col("p_size").cast("string"), 4, "0"))).otherwise("https://other.example.org/x")
    rest = F.when(F.col("p_size") % 3 == 0, F.array(one("more", F.lit("https://more.example.org/y")))).otherwise(F.array().cast("array<struct<label: string, href: string>>"))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.array(one("first", purl)), rest).alias("links"))


@query("select p_partkey, case when p_size % 2 = 0 then 'https://purl.example.org/ab123cd' || lpad(p_size::varchar, 4, '0') end shown, case when p_size % 2 = 0 then 0 else 1 end + case when p_size % 3 = 0 then 1 else 0 end::int n_beside from part")
def p27_embedded_links(spark, sf):
    rows = links(spark, sf).withColumn("one", V.embedded(F.col("links"), r"^https://purl\.example\.org/[a-z]{2}\d{3}[a-z]{2}\d{4}"))
    return rows.select("p_partkey", F.get("one", F.lit(0))["href"].alias("shown"), F.size(V.links_beside(F.col("links"), F.col("one"))).alias("n_beside"))


@query("select event_id, user_id % 256 = 10 inside, user_id % 256 = 10 or user_id between 16 and 31 exempt from events")
def p30_networks(spark, sf):
    ip = F.concat_ws(".", F.col("user_id") % 256, F.lit("20"), F.lit("0"), F.lit("7"))
    other = F.concat_ws(".", F.lit("172"), F.col("user_id"), F.lit("1"), F.lit("1"))
    rows = table(spark, sf, "events").select("event_id", V.address_in(ip, "10.0.0.0/8").alias("inside"), V.is_exempt(other, ["172.16.0.0/12"]).alias("b"))
    return rows.select("event_id", "inside", (F.col("inside") | F.col("b")).alias("exempt"))


@query(f"with {BLOCKS} select id, case when level = 'Collection' then 'MSS ' || id end pill from b")
def p32_unit_pill(spark, sf):
    return blocks(spark, sf).select("id", V.unit_pill(F.col("level"), F.col("sort_isi"), F.concat(F.lit("MSS "), "id")).alias("pill"))


@query("select p_partkey, p_size > 25 online from part")
def p33_online(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.is_online(F.when(F.col("p_size") > 25, F.array(F.lit("true")))).alias("online"))


SHOWN = [U.Shown("Title", "name", compact=True), U.Shown("Extent", lambda: F.array(F.col("brand"), F.lit(""), F.col("type")), separator="<br/>", markup=True), U.Shown("Size", "size", only_if=lambda: F.col("size") > 10)]


def shown_parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("<b>"), "p_name", F.lit("</b>")).alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))


@query('select p_partkey id, p_name "Title", p_brand || \'<br/>\' || p_type "Extent", case when p_size > 10 then p_size::varchar end "Size" from part')
def u6_display(spark, sf):
    return U.display(shown_parts(spark, sf), SHOWN)


@query('select p_partkey id, p_name "Title" from part')
def p31_compact(spark, sf):
    return U.display(shown_parts(spark, sf), SHOWN, compact=True)


@query("select p_partkey id, 'p' || p_partkey || '-' || p_size own, upper(p_name) title_ssm, true checked from part where p_size > 5")
def u2_rules(spark, sf):
    rules = U.Rules().with_field("title_ssm", "p_name", F.lower, F.upper).with_hook(lambda df: df.where("p_size > 5")).with_hook(lambda df: df.withColumn("checked", F.lit(True)))
    rules = rules.replaced(identifier=lambda a, b: F.concat(F.lit("p"), a, F.lit("-"), b))
    rules = rules.with_field("own", lambda df: rules.strategies["identifier"](F.col("p_partkey"), F.col("p_size")))
    return rules.apply(table(spark, sf, "part")).select(F.col("p_partkey").alias("id"), "own", "title_ssm", "checked")


# --- bookmarks, exports, downloads


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def k13_clear_bookmarks(spark, sf):
    users = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return V.clear_for(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), users, "o_custkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 10")
def k14_page_export(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return V.page_only(rows, R.page(rows, F.desc("o_totalprice"), F.col("o_orderkey"), start=10), "o_orderkey")


@query("""select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' json from nation""")
def k12_json_rows(spark, sf):
    return V.json_rows(table(spark, sf, "nation"), "n_nationkey", "n_name")


@query("select p_partkey, case when p_size % 4 = 0 then ['disclaimer'] else [] end || case when p_size > 20 then ['export_info'] else [] end notes from part")
def f28_bookmark_notes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.bookmark_notes(F.when(F.col("p_size") % 4 == 0, 1).otherwise(2), F.lit(20), F.col("p_size")).alias("notes"))


@query("select n_nationkey, '/download/' || n_name || '.xml' xml, '/download/' || n_name || '.pdf' pdf from nation")
def f21_downloads(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", V.download_link(F.col("n_name")).alias("xml"), V.download_link(F.col("n_name"), "pdf").alias("pdf"))


@query("select event_id, case when event_type = 'error' then ['SEVERE: event ' || event_id] else [] end lines from events")
def k6_severe_lines(spark, sf):
    log = F.concat(F.lit("INFO: started\r\n"), F.when(F.col("event_type") == "error", F.concat(F.lit("SEVERE: event "), "event_id")).otherwise("done"), F.lit("\nINFO: ended"))
    return table(spark, sf, "events").select("event_id", V.severe_lines(log).alias("lines"))


@query("select p_partkey, case when p_size > 25 then [p_name || ' more'] else ['https://x.example.org/' || p_partkey] end labels from part")
def f13_digital_objects(spark, sf):
    href = F.concat(F.lit("https://x.example.org/"), "p_partkey")
    made = F.to_json(F.struct(F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(" more"))).otherwise(" ").alias("label"), href.alias("href")))
    return table(spark, sf, "part").select("p_partkey", F.transform(S.digital_objects(F.array(F.lit(" "), made), "https://purl.example.org"), lambda o: o["label"]).alias("labels"))


@query(r"""select doc_id, case when length(t) <= 250 then t when contains(substr(t, 1, 251), ' ') then regexp_replace(substr(t, 1, 251), '\s\S*$', '') else substr(t, 1, 250) end shown
 from (select doc_id, text || ' ' || lang t from documents where text is not null)""")
def f17_restrictions(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", S.restrictions(F.array("text", "lang")).alias("shown"))


@query("select c_custkey, upper(substr(c_mktsegment, 1, 1)) || substr(lower(c_mktsegment), 2) name from customer")
def f26_capitalised(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.capitalised(F.lower("c_mktsegment")).alias("name"))


# --- clocks


def hours(spark, sf):
    opens, closes = F.col("ts"), F.col("ts") + F.expr("interval 90 minutes")
    later = F.struct(F.lit(True).alias("open"), (opens + F.expr("interval 1 day")).alias("opens_at"), (closes + F.expr("interval 1 day")).alias("closes_at"))
    first = F.struct((F.col("event_type") != "error").alias("open"), opens.alias("opens_at"), closes.alias("closes_at"))
    return table(spark, sf, "events").select("event_id", "ts", F.when(F.col("event_id") % 5 != 0, F.array(first, later)).alias("hours"), F.when(F.col("event_id") % 7 == 0, "closed").alias("note"), (F.col("ts") + F.expr("interval 1 minute") * F.col("user_id")).alias("now"))


@query("select event_id, event_id % 5 != 0 and event_id % 7 != 0 and event_type != 'error' and user_id <= 90 open_now, case when event_id % 5 != 0 and event_id % 7 != 0 and user_id < 1440 then case when user_id < 0 then ts else ts + interval 1 day end end next_open from events")
def t3_opening_hours(spark, sf):
    rows = hours(spark, sf)
    note = F.col("note")
    return rows.select("event_id", T.open_now(F.col("hours"), F.col("now"), note).alias("open_now"), T.next_open(F.col("hours"), F.col("now"), note)["opens_at"].alias("next_open"))


@query("select event_id, strftime(ts, '%Y-%m-%d') shown, ts::date first, ts::date + 7 last from events")
def t4_week_range(spark, sf):
    week = T.week_range(F.to_date("ts"))
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("shown"), week["first"].alias("first"), week["last"].alias("last"))


@query("select event_id, case when event_id % 3 != 0 then 1 else 0 end n from events")
def t6_hours_feed(spark, sf):
    good = '{"data": {"attributes": {"hours": [{"open": true, "opens_at": "2024-01-01T08:00:00Z", "closes_at": "2024-01-01T17:00:00Z"}]}}}'
    return table(spark, sf, "events").select("event_id", F.size(T.parse_hours(F.when(F.col("event_id") % 3 != 0, good).otherwise("<html>"))).alias("n"))


@query("select o_orderkey, o_orderdate < timestamp '1998-01-01' - interval 6 month old from orders")
def t8_cutoff(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate") < T.cutoff(F.expr("timestamp_ntz'1998-01-01'"), months=6)).alias("old"))


# --- display of finding aids

LEVELS = "['subcollection', 'otherlevel', 'file', 'class', 'item']"


@query(f"select p_partkey, l in ('subcollection', 'class') or (l = 'otherlevel' and p_size % 2 = 0) series from (select *, {LEVELS}[p_size % 5 + 1] l from part)")
def x8_series(spark, sf):
    level = F.get(F.array(*map(F.lit, ["subcollection", "otherlevel", "file", "class", "item"])), F.col("p_size") % 5)
    return table(spark, sf, "part").select("p_partkey", E.is_series(level, F.col("p_size") % 2 == 1).alias("series"))


@query("select p_partkey, case when p_size % 2 = 0 then p_brand else p_name end title, 'n' || p_partkey node from part")
def x16_titles(spark, sf):
    one = lambda kind, c: F.struct(kind.alias("type"), F.col(c).alias("value"))
    titles = F.array(one(F.when(F.col("p_size") % 2 == 0, "filing"), "p_name"), one(F.lit(None).cast("string"), "p_brand"))
    return table(spark, sf, "part").select("p_partkey", E.first_title(titles).alias("title"), E.node_id(F.lit(None).cast("string"), F.col("p_partkey")).alias("node"))


@query("select p_partkey, case when p_size % 3 = 0 then p_name when p_size % 3 = 1 then p_brand else p_type end title from part")
def x17_object_title(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.object_title(F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(""), F.when(F.col("p_size") % 3 == 1, F.col("p_brand")), F.col("p_type")).alias("title"))


@query("""with n as (select 'r' || r_regionkey root, 's' || n_nationkey id, case when n_nationkey % 4 = 0 then 'series' else 'subseries' end l, n_nationkey i, case when n_nationkey % 4 != 0 then 's' || (n_nationkey - n_nationkey % 4) end up from nation join region on n_regionkey = r_regionkey)
 select root _root_, n.id, case when l = 'subseries' then up end parent, case when l = 'subseries' and up is not null then 2 else 1 end depth, (row_number() over (partition by root order by i, n.id))::int place from n""")
def x12_contents(spark, sf):
    key = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(
        F.concat(F.lit("r"), "n_regionkey").alias("_root_"), F.concat(F.lit("s"), key).alias("id"), F.when(key % 4 == 0, "Series").otherwise("Subseries").alias("level"), key.alias("sort_isi"),
        F.when(key % 4 != 0, F.concat(F.lit("s"), key - key % 4)).alias("_nest_parent_"), F.col("n_name").alias("title"),
    )
    return V.contents(rows).drop("title")
