"""Queries over the driver's tables: each applies an operator of this engine, beside the same query as DuckDB SQL.

Shapes: orders are collections and lineitems their components; nations and regions are the repository dimension;
events are feeds and clocks; documents are the ranked text; part names are multi-valued facets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import analyzers as A, text as S, times as T
from ..operators import export as E, harvest as H, lookups as L, relational as R
from . import execute as P, request as Q, search as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Collections and components: id, _root_, sort_isi, level, year, price."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("_root_"), F.lit(0).alias("sort_isi"), F.lit("Collection").alias("level"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"))
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("_root_"), F.col("l_linenumber").alias("sort_isi"), F.lit("File").alias("level"), F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("price"))
    return o.unionByName(li)


BLOCKS = """b as (select o_orderkey id, o_orderkey _root_, 0 sort_isi, 'Collection' level, year(o_orderdate)::int "year", o_totalprice price from orders
 union all select l_orderkey * 100 + l_linenumber, l_orderkey, l_linenumber, 'File', year(l_shipdate)::int, l_extendedprice from lineitem)"""


# --- scans, filters, projections


@query("select o_orderkey id, o_custkey from orders where o_orderstatus = 'F' order by 1")
def s11_filtered_scan(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").orderBy("o_orderkey").select(F.col("o_orderkey").alias("id"), "o_custkey")


@query("select o_orderkey, o_totalprice from orders where o_orderkey = (select min(o_orderkey) from orders) limit 1")
def s12_point_lookup(spark, sf):
    first = table(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]
    return L.document(table(spark, sf, "orders"), first, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("select p_partkey, string_split(p_name, ' ') words from part where list_contains(string_split(p_name, ' '), string_split(p_name, ' ')[1]) and p_size > 10")
def p5_exact_filter(spark, sf):
    return table(spark, sf, "part").withColumn("words", F.split("p_name", " ")).where(R.all_of(R.has("words", F.get("words", F.lit(0))), None, F.col("p_size") > 10)).select("p_partkey", "words")


@query("select l_orderkey, count(*) n from lineitem where not coalesce(list_contains(case when l_returnflag != 'N' then [l_returnflag] end, 'R'), false) group by 1")
def p6_negated_filter(spark, sf):
    return table(spark, sf, "lineitem").withColumn("flags", F.when(F.col("l_returnflag") != "N", F.array("l_returnflag"))).where(R.lacks("flags", "R")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey from customer where len(list_filter([c_nationkey, c_nationkey + 10], lambda y: y between 12 and 20)) > 0")
def p9_range_filter(spark, sf):
    return table(spark, sf, "customer").withColumn("years", F.array(F.col("c_nationkey"), F.col("c_nationkey") + 10)).where(R.in_range("years", 12, 20)).select("c_custkey")


SOURCE = """src as (select o_orderkey, '/repositories/2/resources/' || o_orderkey uri, case when o_orderstatus = 'O' then 'archival_object' else 'resource' end primary_type, o_orderstatus != 'P' publish,
 o_orderdate system_mtime, case when o_custkey % 7 != 0 then 'id' || o_custkey end ead_id from orders)"""


def source(spark, sf):
    """Orders as records of the source."""
    return table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("/repositories/2/resources/"), "o_orderkey").alias("uri"), F.when(F.col("o_orderstatus") == "O", "archival_object").otherwise("resource").alias("primary_type"),
        (F.col("o_orderstatus") != "P").alias("publish"), F.col("o_orderdate").alias("system_mtime"), F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("id"), "o_custkey")).alias("ead_id"),
    )


@query(f"with {SOURCE} select uri from src where publish and system_mtime::date > date '1996-01-01' and primary_type = 'resource' and ead_id is not null and coalesce(ead_id not in ('id1', 'id2'), true)")
def p10_source_query(spark, sf):
    return source(spark, sf).where(H.source_filter(published=True, updated_after="1996-01-01", contains=("ead_id",), exclude={"ead_id": ["id1", "id2"]})).select("uri")


@query(f"with {SOURCE} select uri from src where system_mtime::date > date '1997-06-01'")
def p16_updated_after(spark, sf):
    return source(spark, sf).where(H.source_filter(primary_type=None, updated_after="1997-06-01")).select("uri")


@query(f"with {SOURCE} select o_orderkey, uri, ead_id from src where ead_id is null or ead_id not in ('id3', 'id4', 'id5')")
def p17_exclude_values(spark, sf):
    return source(spark, sf).where(H.source_filter(primary_type=None, exclude={"ead_id": ["id3", "id4", "id5"]})).select("o_orderkey", "uri", "ead_id")


@query(f"with {SOURCE} select o_orderkey, uri from src where uri in (select '/repositories/2/resources/' || l_orderkey from lineitem where l_quantity > 45)")
def p18_restrict_uris(spark, sf):
    listed = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("/repositories/2/resources/"), "l_orderkey").alias("uri"))
    return H.restrict(source(spark, sf), listed).select("o_orderkey", "uri")


@query(f"with {SOURCE} select uri from src where false")
def p18_empty_restriction(spark, sf):
    return source(spark, sf).where(H.source_filter(uris=[])).select("uri")


@query(f"with {SOURCE} select o_orderkey, string_split(uri, '/')[-1] id, starts_with(uri, '/repositories/2/resources') resource from src")
def p4_uri_tail(spark, sf):
    return source(spark, sf).select("o_orderkey", S.tail_of(F.col("uri")).alias("id"), F.col("uri").startswith("/repositories/2/resources").alias("resource"))


@query(f"with {BLOCKS} select level, count(*) filter (lower(level) = 'collection' and sort_isi = 0) n from b group by 1")
def p23_is_collection(spark, sf):
    return blocks(spark, sf).groupBy("level").agg(F.count_if(R.is_collection(F.col("level"), F.col("sort_isi"))).alias("n"))


# --- joins


@query("select l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_totalprice root_price, case when o.o_orderkey is not null then 1 else 0 end n_roots from lineitem l left join orders o on l.l_orderkey = o.o_orderkey")
def j1_root_subquery(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("_root_"), (-F.monotonically_increasing_id() - 1).alias("id"), "l_linenumber", "l_partkey", F.lit(None).cast("double").alias("price"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_root_"), F.col("o_orderkey").alias("id"), F.lit(None).cast("int").alias("l_linenumber"), F.lit(None).cast("long").alias("l_partkey"), F.col("o_totalprice").alias("price"))
    out = R.with_root(b.unionByName(o)).where("l_linenumber is not null")
    return out.select(F.col("_root_").alias("l_orderkey"), "l_linenumber", "l_partkey", F.get("collection", F.lit(0))["price"].alias("root_price"), F.coalesce(F.size("collection"), F.lit(0)).alias("n_roots"))


@query("select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def j2_dimension_lookup(spark, sf):
    settings = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    found = L.with_repository(table(spark, sf, "customer"), settings, "c_nationkey", ("n_nationkey",))
    return found.select("c_custkey", F.col("repository_n_name").alias("n_name"), F.col("repository_r_name").alias("r_name"))


@query("select o_orderkey ark, max(o_custkey) id from orders where o_orderkey not in (select l_orderkey from lineitem) group by 1")
def j3_stale_ids(spark, sf):
    published = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ark")).distinct()
    return R.stale(table(spark, sf, "orders").select(F.col("o_orderkey").alias("ark"), F.col("o_custkey").alias("id")), published, "ark")


@query("select distinct l_orderkey uri from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal < 1000)")
def j4_linked_agents(spark, sf):
    agents = table(spark, sf, "supplier").where("s_acctbal < 1000").select(F.col("s_suppkey").alias("agent"))
    li = table(spark, sf, "lineitem")
    record = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("record")
    return H.linked_resources(agents, li.select(F.col("l_suppkey").alias("agent"), record), li.select(record, F.col("l_orderkey").alias("resource")))


@query("select distinct l_orderkey uri from lineitem where l_shipdate >= timestamp '1998-01-01'")
def j5_component_parents(spark, sf):
    return H.parents_of(table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz'1998-01-01'").select(F.col("l_orderkey").alias("resource")))


@query("select o_orderkey uri from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def j6_exclude_uris(spark, sf):
    return H.exclude(table(spark, sf, "orders").select(F.col("o_orderkey").alias("uri")), table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("uri")))


@query("select o_orderkey id from orders where o_orderstatus = 'F' and o_orderdate < timestamp '1997-01-01' and o_orderkey not in (select l_orderkey from lineitem)")
def j7_prune_guests(spark, sf):
    users = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("guest"), F.col("o_orderdate").alias("updated_at"))
    return H.idle_guests(users, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("user_id")), F.expr("timestamp_ntz'1997-01-01'")).select("id")


@query("select o_orderkey, o_custkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 300000")
def j8_bookmarks(spark, sf):
    return L.bookmarked(table(spark, sf, "orders").where("o_totalprice > 300000"), table(spark, sf, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey", "c_name")


HIERARCHY = "h as (select 'r' || r_regionkey id, null parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier)"


@query(f"with recursive {HIERARCHY}, t as (select id, [id] path from h where parent is null union all select h.id, list_append(t.path, h.id) from h join t on h.parent = t.id) select id, path from t")
def j9_ancestors(spark, sf):
    make = lambda t, a, k, b, p: table(spark, sf, t).select(F.concat(F.lit(a), k).alias("id"), (F.concat(F.lit(b), p) if p else F.lit(None).cast("string")).alias("_nest_parent_"))
    return R.ancestors(make("region", "r", "r_regionkey", "", None).unionByName(make("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(make("supplier", "s", "s_suppkey", "n", "s_nationkey")))


@query("select n_nationkey id, n_nationkey sort_isi from nation where n_regionkey = 1 order by 1 limit 50")
def j10_children(spark, sf):
    return R.children_of(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("sort_isi"), F.col("n_regionkey").alias("_nest_parent_")), 1).select("id", "sort_isi")


# --- aggregations


FACETS = "f as (select 'name' field, unnest(list_distinct(string_split(p_name, ' '))) \"value\" from part union all select 'brand', p_brand from part union all select 'type', p_type from part)"


def facets(spark, sf):
    part = table(spark, sf, "part").select(F.split("p_name", " ").alias("name"), F.array("p_brand").alias("brand"), F.array("p_type").alias("type"))
    return R.facet_counts(part, ["name", "brand", "type"])


@query(f'with {FACETS} select field, "value", count(*) "count" from f where "value" is not null group by 1, 2')
def g1_facet_counts(spark, sf):
    return facets(spark, sf)


@query(f'with {FACETS}, c as (select field, "value", count(*) "count" from f where "value" is not null group by 1, 2) select field, "value", "count", place::int place from (select *, row_number() over (partition by field order by "count" desc, "value") place from c) where place <= 11')
def g2_facet_top10(spark, sf):
    return R.top_facets(facets(spark, sf))


@query("select count(*) filter (p_type = 'PROMO' or p_size > 40) online, count(*) total from part")
def g3_facet_query(spark, sf):
    return L.query_counts(table(spark, sf, "part"), online=(F.col("p_type") == "PROMO") | (F.col("p_size") > 40), total=F.lit(True))


@query('select (floor(year(o_orderdate) / 2.0) * 2)::int bucket, count(*) "count" from orders group by 1')
def g4_range_histogram(spark, sf):
    return R.histogram(table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")), "year", 2)


@query("select count(*) hits from orders where o_orderpriority like '1%'")
def g5_hits(spark, sf):
    return L.hits(table(spark, sf, "orders").where("o_orderpriority like '1%'"))


@query(f"with {BLOCKS} select count(*) collections from b where level = 'Collection'")
def g6_collections(spark, sf):
    return L.collections(blocks(spark, sf))


@query("select n_name repository, count(c_custkey) n, format('{:,}', count(c_custkey)) || ' ' || case when count(c_custkey) = 1 then 'collection' else 'collections' end label from nation left join customer on c_nationkey = n_nationkey group by 1")
def g7_per_repository(spark, sf):
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("repository"))
    return L.per_repository(nations, table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey").select("repository", "n", "label")


@query("select l_orderkey _root_, count(*) components, count(*) filter (l_returnflag = 'R') online, max(l_shipdate)::date last_indexed from lineitem group by 1")
def g8_root_totals(spark, sf):
    return L.collection_totals(table(spark, sf, "lineitem"), F.col("l_returnflag") == "R", "l_shipdate", "l_orderkey")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, place::int place, group_total from (select *, count(*) over (partition by l_orderkey) group_total,
 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) place from lineitem) where place <= 3""")
def g9_group_top3(spark, sf):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = table(spark, sf, "lineitem").select("l_orderkey", *order)
    return R.group_top(li, "l_orderkey", *map(F.col, order)).select("l_orderkey", *order, "place", "group_total")


@query("select distinct o_custkey uri from orders where o_orderstatus = 'P' union select c_custkey from customer where c_acctbal < 0")
def o13_union(spark, sf):
    return R.union_keys(table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("uri")), table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("uri")))


# --- orders, pages, sets


@query("select p_partkey, regexp_replace(trim(lower(p_name || ' ' || p_brand)), '[^a-z0-9]', '', 'g') title_sort from part order by 2, 1 limit 100")
def o2_text_sort(spark, sf):
    keyed = table(spark, sf, "part").select("p_partkey", S.sort_text(F.concat_ws(" ", "p_name", "p_brand")).alias("title_sort"))
    return R.page(keyed, R.text_order("title_sort"), F.col("p_partkey"), rows=100)


@query(f"with {BLOCKS} select id, _root_, sort_isi from b order by case when sort_isi = 0 then 0.0 else 1.0 / sort_isi end desc, _root_, id limit 200")
def o3_collection_last(spark, sf):
    return R.page(blocks(spark, sf).select("id", "_root_", "sort_isi"), R.collection_last(), F.col("_root_"), F.col("id"), rows=200)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 20")
def o7_page(spark, sf):
    return R.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey"), start=20)


@query("select n_nationkey, n_name from nation where n_regionkey in (3, 1)")
def o10_custom_order(spark, sf):
    return R.custom_order(table(spark, sf, "nation").withColumn("k", F.col("n_regionkey").cast("string")), "k", ["3", "1"]).select("n_nationkey", "n_name")


@query("select o_custkey k from orders except select c_custkey from customer where c_acctbal > 0")
def o14_except(spark, sf):
    return L.unpublished(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey"), "k")


@query("select 'c' kind, c_nationkey nation from customer union all select 's', s_nationkey from supplier")
def o15_union_all(spark, sf):
    kind = lambda t, name, key: table(spark, sf, t).select(F.lit(name).alias("kind"), F.col(key).alias("nation"))
    return L.together(kind("customer", "c", "c_nationkey"), kind("supplier", "s", "s_nationkey"))


@query('select (k // 3)::int chunk, list(n_name order by n_name) "values" from (select n_name, row_number() over (order by n_name) - 1 k from nation) group by 1')
def o17_chunks(spark, sf):
    return R.chunks(table(spark, sf, "nation"), F.col("n_name"), 3, "n_name")


@query("select id, path[3:4] crumbs, path grouped_off from (select 's' || s_suppkey id, ['r' || n_regionkey, 'n' || n_nationkey, 's' || s_suppkey] path from supplier join nation on s_nationkey = n_nationkey)")
def o19_breadcrumbs(spark, sf):
    path = F.array(F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("s"), "s_suppkey"))
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), path.alias("path"))
    return rows.select("id", R.breadcrumbs(F.col("path"), F.lit(True), F.lit(True)).alias("crumbs"), R.breadcrumbs(F.col("path"), F.lit(False), F.lit(False)).alias("grouped_off"))


@query(f"""with {BLOCKS}, fresh as (select o_orderkey id, o_orderkey _root_, 0 sort_isi, 'New' level, 1 "year", -1.0 price from orders where o_orderstatus = 'P')
 select id, _root_, sort_isi, level, "year", price from b where _root_ not in (select _root_ from fresh) union all select * from fresh""")
def k1_upsert(spark, sf):
    fresh = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("_root_"), F.lit(0).alias("sort_isi"), F.lit("New").alias("level"), F.lit(1).alias("year"), F.lit(-1.0).alias("price"), F.lit(1).cast("long").alias("_version_"))
    return R.upsert(blocks(spark, sf), fresh)


@query(f"with {BLOCKS} select level, count(*) n from b where _root_ not in (select o_orderkey from orders where o_orderstatus = 'F') group by 1")
def k2_delete_blocks(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return R.delete_blocks(blocks(spark, sf), gone).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("select page_id::varchar id, '' repository, '' collection_unitid, url ead_id, '' \"level\", regexp_replace(html, '<[^>]*>', '', 'g') title, '' \"date\", 'a|b' containers, '' description, '' extent from pages")
def k4_csv_rows(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("ead_ssi"), F.array("html").alias("normalized_title_ssm"), F.array(F.lit("a"), F.lit("b")).alias("containers_ssim"))
    return E.csv_rows(p)


@query("select p_partkey, list_filter([{'label': 'name', 'value': p_name}, {'label': 'brand', 'value': case when p_size > 25 then p_brand end}], lambda f: f.value is not null and f.value != '') fields from part")
def k9_present_fields(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.present_fields(name=F.col("p_name"), brand=F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("fields"))


# --- scalar functions


@query("""select p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(p_name || ' ' || p_type || '.XML', '\\.xml$', '', 'i'), '\\s+'),
 lambda w: lower(regexp_replace(regexp_replace(regexp_replace(w, '[^A-Za-z0-9_-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-|-$', '', 'g'))), lambda w: w != '')[1:5], '-') id from part""")
def f1_identifier(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.ascii_identifier(F.lit(None).cast("string"), F.lit(" "), F.concat("p_name", F.lit(" "), "p_type", F.lit(".XML"))).alias("id"))


@query("select p_partkey, case when p_size % 5 = 0 then case when p_size % 2 = 0 then '[NO TITLE PROVIDED]' else p_brand end when p_size % 2 = 0 then p_name else p_name || ', ' || p_brand end title from part")
def f4_title(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.title(F.when(F.col("p_size") % 5 != 0, F.concat("p_name", F.lit(" , "))), F.when(F.col("p_size") % 2 != 0, F.col("p_brand"))).alias("title"))


@query("select c_custkey, c_mktsegment || '.' \"language\" from customer")
def f5_language(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.language(F.concat("c_mktsegment", F.lit(" . "))).alias("language"))


ARK = "md5(o_orderkey::varchar)"


@query(f"select o_orderkey, 'ark:/12345/c8' || {ARK} ark, 'c8' shoulder, regexp_replace('ark:/12345/c8' || {ARK}, '^(.{{13}})(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1\\2-\\3-\\4-\\5-\\6') normal, true valid from orders")
def f9_ark(spark, sf):
    href = F.concat(F.lit("https://example.org/findingaid/ark:/12345/c8"), F.md5(F.col("o_orderkey").cast("string")))
    out = table(spark, sf, "orders").select("o_orderkey", S.ark(href).alias("ark"), S.ark_shoulder(href).alias("shoulder"))
    return out.withColumn("normal", S.hyphenate_ark(F.col("ark"))).withColumn("valid", S.is_ark(F.col("normal")))


@query("select n_nationkey, md5(n_name) hashed_id from nation")
def f8_md5(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", L.digest("n_name").alias("hashed_id"))


@query("""select p_partkey, case when p_size % 3 = 0 then 'edu' when x in ('amernews', 'comics', 'macweek', 'pn', 'sanitary') then 'rarebooks' when x in ('a', 'f', 'pc', 'sc', 'scm', 'v') then 'uarc' else 'manuscripts' end code
 from (select *, (['pc', 'm', 'comics', 'SCM', 'F'])[p_size % 5 + 1] y, lower(y) x from part)""")
def f10_repository_code(spark, sf):
    prefix = F.get(F.array(*map(F.lit, ["pc", "m", "comics", "SCM", "F"])), F.col("p_size") % 5)
    return table(spark, sf, "part").select("p_partkey", S.repository_code(F.when(F.col("p_size") % 3 == 0, "edu").otherwise("speccoll"), F.concat(prefix, F.lpad("p_size", 4, "0"))).alias("code"))


@query("select page_id, case when starts_with(url, 'http://www.') then 'https' || substr(url, 5) else url end href from pages where url is not null")
def f12_link(spark, sf):
    return table(spark, sf, "pages").where("url is not null").select("page_id", S.link(F.concat(F.lit(" "), "url"), "https://www.").alias("href"))


@query("select page_id, regexp_replace(html, '<[^>]*>', '', 'g') \"text\" from pages")
def f18_strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.strip_tags(F.col("html")).alias("text"))


@query(r"""select doc_id, case when length(t) <= 400 then t when contains(h, ' ') then regexp_replace(h, '\s\S*$', '') || '...' else substr(t, 1, 397) || '...' end short
 from (select doc_id, regexp_replace(text, '<[^>]*>', '', 'g') t, substr(regexp_replace(text, '<[^>]*>', '', 'g'), 1, 398) h from documents)""")
def f14_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.truncate(S.strip_tags(F.col("text")), 400).alias("short"))


@query(r"""with x as (select p_partkey, p_name || '; ' || p_brand || '; ' || p_type || '; ' || p_container_like t from (select *, p_brand || ' ' || p_size as p_container_like from part)),
 y as (select p_partkey, t, regexp_extract(t, '(?s)^((?:.+?[\s,;]){5}.+?)[\s,;].*$', 1) c from x) select p_partkey, case when c = '' then t else c || '...' end extent from y""")
def f15_extent(spark, sf):
    parts = F.array("p_name", "p_brand", "p_type", F.concat_ws(" ", "p_brand", "p_size"))
    return table(spark, sf, "part").select("p_partkey", S.extent(parts).alias("extent"))


@query("select n_nationkey, '/data/' || lower(n_name) || '/f' || n_nationkey || '.pdf' pdf, 'f' || n_nationkey || '.pdf' \"name\" from nation")
def f20_file_names(spark, sf):
    name = F.concat(F.lit("f"), "n_nationkey", F.lit(".xml"))
    return table(spark, sf, "nation").select("n_nationkey", S.file_path(F.concat(F.lit("/data/"), F.lower("n_name")), name, "pdf").alias("pdf"), S.pdf_name(name).alias("name"))


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 'author' else s_name end role from supplier")
def x14_role(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", S.role(F.when(F.col("s_suppkey") % 2 == 0, "author (aut)").otherwise(F.col("s_name"))).alias("role"))


@query("select event_id, date_trunc('hour', ts) + case when minute(ts) < 30 then interval 30 minute else interval 60 minute end half, greatest(5, least(1800, datediff('second', date_trunc('second', ts), date_trunc('hour', ts) + case when minute(ts) < 30 then interval 30 minute else interval 60 minute end)))::bigint wait from events")
def t1_next_half_hour(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", T.next_half_hour(ts).cast("timestamp_ntz").alias("half"), T.seconds_until_next_half_hour(ts.cast("timestamp")).alias("wait"))


@query("select event_id, case when hour(ts) % 12 = 0 then 12 else hour(ts) % 12 end::varchar || case when minute(ts) != 0 then ':' || lpad(minute(ts)::varchar, 2, '0') else '' end || case when hour(ts) >= 12 then 'pm' else 'am' end || ' ' || dayname(ts) clock from events")
def t5_clock(spark, sf):
    return table(spark, sf, "events").select("event_id", T.clock(F.col("ts"), F.lit("1970-01-01").cast("date")).alias("clock"))


@query("select event_id, monthname(ts) || ' ' || strftime(ts, '%d, %Y') shown, strftime(ts::date - 2, '%Y-%m-%d') two_days_ago from events")
def t9_long_date(spark, sf):
    return table(spark, sf, "events").select("event_id", T.long_date(F.col("ts")).alias("shown"), T.days_ago(F.to_date("ts"), 2).alias("two_days_ago"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def n1_json_dig(spark, sf):
    return table(spark, sf, "events").select("event_id", L.dig(F.col("props"), "$.k", "long").alias("k"))


@query("""select l_orderkey, run::bigint run, count(*) n from (select l_orderkey, sum(case when l_returnflag = 'R' then 1 else 0 end) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) run from lineitem) group by all""")
def x9_container_groups(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), F.when(F.col("l_returnflag") == "R", "Box").alias("label"))
    return E.container_groups(li, "l_orderkey", "at").groupBy("l_orderkey", "run").agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, max(greatest(least(l_linenumber, 12), 1) * 8)::int indent, min(chr(96 + l_linenumber)) letter from lineitem group by 1")
def x13_list_numbers(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(E.indent(F.col("l_linenumber"))).alias("indent"), F.min(E.list_number(F.col("l_linenumber"), F.lit("loweralpha"))).alias("letter"))


@query("select p_partkey, case when p_size > 20 then p_name || ', (' || p_brand || ')' else p_name || ', ' || p_brand end || case when p_size % 2 = 0 then ' (online item available)' else '' end title from part")
def x10_component_title(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.component_title(F.col("p_name"), F.col("p_brand"), F.when(F.col("p_size") > 20, "bulk"), F.col("p_size") % 2 == 0).alias("title"))


# --- harvest


@query("""with own as (select o_orderkey uri from orders where o_orderdate >= timestamp '1998-06-01'), comp as (select l_orderkey uri from lineitem where l_shipdate >= timestamp '1998-08-01'),
 agent as (select l_orderkey uri from lineitem where l_suppkey = 1) select uri from own union select uri from comp union select uri from agent""")
def w3_changes(spark, sf):
    li = table(spark, sf, "lineitem")
    own = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1998-06-01'").select(F.col("o_orderkey").alias("uri"))
    return H.changes(own, H.parents_of(li.where("l_shipdate >= timestamp_ntz'1998-08-01'").select(F.col("l_orderkey").alias("resource"))), li.where("l_suppkey = 1").select(F.col("l_orderkey").alias("uri")))


@query("select o_orderkey, case when o_custkey % 7 = 0 then 'no identifier' else 'unknown repository' end reason from orders where o_custkey % 7 = 0 or o_orderpriority not in ('1-URGENT', '2-HIGH')")
def w6_quarantine(spark, sf):
    name = F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("f"), "o_custkey"))
    codes = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "code string")
    return H.quarantine(table(spark, sf, "orders"), name, F.col("o_orderpriority"), codes)[1].select("o_orderkey", "reason")


# --- full text

TERMS = ["the", "of", "and", "thinor", "reresh"]
WORDS = r"list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda w: w != '')"


@query(f"select doc_id, len(list_intersect(list_distinct({WORDS}), ['the', 'of', 'and', 'thinor', 'reresh']))::int n_terms from documents where len(list_intersect(list_distinct({WORDS}), ['the', 'of', 'and', 'thinor', 'reresh'])) >= 4")
def q5_min_match(spark, sf):
    return X.enough_terms(table(spark, sf, "documents"), TERMS, "4<90%", "text").select("doc_id", "n_terms")


@query(f"""with w as (select doc_id, {WORDS} words from documents), t as (select doc_id id, len(words) n, regexp_replace(unnest(words), '^(thinor|oranst|hate)s$', '\\1') term from w), tf as (select id, n, term, count(*) tf from t group by all),
 s as (select count(distinct id) docs, sum(tf) / count(distinct id) mean_len from tf), h as (select * from tf where term in ('thinor', 'oranst', 'hate')), d as (select term, count(*) df from h group by 1)
 select id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean_len))), 6) score, count(*) n_terms from h join d using (term) cross join s group by 1""")
def q2_dismax(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    request = Q.SearchRequest(q="thinor oranst hate", qf={"text": 1}, pf={}, mm="1")
    return P.dismax(docs, request).select("id", F.round("score", 6).alias("score"), "n_terms")


#: The minimal plural rule, word by word.
STEMS = f"""list_transform({WORDS}, lambda w: case when length(w) < 3 or not ends_with(w, 's') or w in ('dontstems', 'zwhacky') then w
 when regexp_matches(w, '[ae]ies$') then w when ends_with(w, 'ies') then regexp_replace(w, 'ies$', 'y')
 when regexp_matches(w, '[aeo]es$') or regexp_matches(w, '[us]s$') then w else regexp_replace(w, 's$', '') end)"""


@query(f"select doc_id from documents where contains(' ' || array_to_string({STEMS}, ' ') || ' ', ' of the ')")
def q9_phrase(spark, sf):
    return table(spark, sf, "documents").where(Q.matches(Q.parse('"of the"'), A.analyze_one(F.col("text")))).select("doc_id")


@query(f"select doc_id from documents where len(list_filter({WORDS}, lambda w: regexp_matches(w, '^thin.*r$'))) > 0 and len(list_filter({WORDS}, lambda w: w in ('hate', 'hates'))) = 0")
def q8_boolean(spark, sf):
    return table(spark, sf, "documents").where(Q.matches(Q.parse("thin*r AND -hate"), A.analyze_one(F.col("text")))).select("doc_id")


@query(f"""with t as (select unnest(list_distinct({WORDS})) term from documents), f as (select term, count(*) freq from t group by 1), o as (select coalesce(max(freq), 0) own from f where term = 'thinr')
 select term, freq, round(1 - levenshtein(term, 'thinr') / greatest(length(term), 5), 6) accuracy from f cross join o where term != 'thinr' and 1 - levenshtein(term, 'thinr') / greatest(length(term), 5) >= 0.7 and freq > own order by accuracy desc, freq desc, term limit 5""")
def q13_spelling(spark, sf):
    terms = table(spark, sf, "documents").select(F.explode(F.array_distinct(A.analyze_one(F.col("text")))).alias("term"))
    return X.spelling(terms.groupBy("term").agg(F.count(F.lit(1)).alias("freq")), "thinr")


@query("select distinct p_name \"value\" from part where lower(p_name) like '%re%' order by length(p_name), p_name limit 5")
def q14_suggest(spark, sf):
    return X.suggest(table(spark, sf, "part"), "p_name", "RE")


@query("select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w = 'the'))::int n, text like '%<em>%' marked from documents where lang = 'en'")
def q12_term_places(spark, sf):
    words = A.analyze_one(F.col("text"))
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.size(F.filter(words, lambda w: w == "the")).alias("n"), F.col("text").contains("<em>").alias("marked"))
