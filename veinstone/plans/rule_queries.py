"""Queries over finding aids, harvest plans, analysis chains and export rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import analyzers as A, text as S
from ..operators import export as E, harvest as H, relational as R, schema as D
from ..sources import ead
from ..streaming import harvest as W
from . import request as Q
from .catalog import query, table

# --- finding aids: each customer is a file, whose orders are its components


def files(spark, sf):
    """(path, content, repository): XML of one collection for each customer, its orders by key."""
    o = table(spark, sf, "orders")
    part = F.format_string(
        '<c01 id="o%d" level="file"><did><unittitle>Order %d ,</unittitle><unitdate normal="%d/%d">dated %d</unitdate><container type="Box">%d</container></did></c01>',
        "o_orderkey", "o_orderkey", F.year("o_orderdate"), F.year("o_orderdate") + F.col("o_orderkey") % 3, F.year("o_orderdate"), F.col("o_orderkey") % 10,
    )
    parts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("xml")))).alias("parts"))
    c = table(spark, sf, "customer").join(parts, "c_custkey", "left")
    inner = F.coalesce(F.array_join(F.transform("parts", lambda p: p["xml"]), ""), F.lit(""))
    ark = F.concat(F.lit("https://x.example.org/ark:/12345/c8"), F.md5(F.col("c_custkey").cast("string")))
    head = F.format_string(
        '<ead><eadheader><eadid>%s.xml</eadid></eadheader><archdesc level="collection"><did><unittitle>Papers of %s</unittitle><unitid>M.%d</unitid><unitid type="ark"><extref href="%s">Archival Resource Key</extref></unitid><unitid>/repositories/1/resources/%d</unitid><langmaterial>English .</langmaterial></did><controlaccess><geogname>%s</geogname></controlaccess><dsc>',
        "c_name", "c_name", "c_custkey", ark, "c_custkey", "c_mktsegment",
    )
    xml = F.concat(head, inner, F.lit("</dsc></archdesc></ead>"))
    return c.select("c_custkey", F.concat(F.lit("/in/"), "c_name").alias("path"), F.encode(xml, "UTF-8").alias("content"), F.lower("c_mktsegment").alias("repository"))


#: The name is one word whose sign becomes a hyphen.
ROOT = "'customer-' || lpad(c_custkey::varchar, 9, '0')"


@query(f"""with r as (select {ROOT} id, 'customer#' || lpad(c_custkey::varchar, 9, '0') nm, * from customer)
 select id, id _root_, null::varchar _nest_parent_, 0 sort_isi, 0 depth, 'collection' "level", 'Papers of ' || c_name title, c_mktsegment place, lower(c_mktsegment) repository, []::int[] "years", null::varchar box, md5(id) hashed from r
 union all select id || '_o' || o_orderkey, id, id, (row_number() over (partition by id order by o_orderkey))::int, 1, 'file', 'Order ' || o_orderkey || ', dated ' || year(o_orderdate), null, lower(c_mktsegment),
  range(year(o_orderdate), year(o_orderdate) + o_orderkey % 3 + 1)::int[], 'Box ' || o_orderkey % 10, md5(id || '_o' || o_orderkey) from r join orders on o_custkey = c_custkey""")
def x1_documents(spark, sf):
    first = lambda c: F.get(c, F.lit(0))
    return ead.to_documents(files(spark, sf)).select(
        "id", "_root_", "_nest_parent_", "sort_isi", first("component_level_isim").alias("depth"), first("level_ssm").alias("level"), first("normalized_title_ssm").alias("title"), first("places_ssim").alias("place"),
        first("repository_ssim").alias("repository"), F.col("date_range_isim").alias("years"), first("containers_ssim").alias("box"), F.col("hashed_id_ssi").alias("hashed"),
    )


@query(f"""select {ROOT} id, 'ark:/12345/c8' || md5(c_custkey::varchar) ark, 'c8' shoulder, ['M.' || c_custkey] unitids, ['English.'] languages, c_name || '.xml' ead_id from customer""")
def p22_collection_identifiers(spark, sf):
    docs = ead.to_documents(files(spark, sf)).where("sort_isi = 0")
    return docs.select("id", F.col("ark_id_ssi").alias("ark"), F.col("ark_shoulder_ssi").alias("shoulder"), F.col("unitid_ssm").alias("unitids"), F.col("language_ssim").alias("languages"), F.col("ead_ssi").alias("ead_id"))


@query("select '/in/' || c_name path, 'no archdesc' error from customer where c_custkey % 4 = 1 union all select '/in/' || c_name, 'entities are not allowed' from customer where c_custkey % 4 = 2")
def w6_bad_files(spark, sf):
    key = F.col("c_custkey") % 4
    spoiled = F.when(key == 1, F.lit(b"<ead/>")).when(key == 2, F.lit(b'<!DOCTYPE ead [<!ENTITY a "b">]><ead/>')).otherwise(F.col("content"))
    return ead.bad_files(files(spark, sf).withColumn("content", spoiled))


# --- analysis chains

PLURALS = "p_name || ' Boxes Stories buses'"


@query(f"""select p_partkey, flatten(list_transform(string_split(lower({PLURALS}), ' '), lambda w, i: case w when 'boxes' then [{{'pos': i::int - 1, 'token': w}}, {{'pos': i::int - 1, 'token': 'boxe'}}]
 when 'stories' then [{{'pos': i::int - 1, 'token': w}}, {{'pos': i::int - 1, 'token': 'story'}}] when 'buses' then [{{'pos': i::int - 1, 'token': w}}, {{'pos': i::int - 1, 'token': 'buse'}}] else [{{'pos': i::int - 1, 'token': w}}] end)) tokens from part""")
def a1_text_chain(spark, sf):
    return table(spark, sf, "part").select("p_partkey", A.analyze(F.concat("p_name", F.lit(" Boxes Stories buses"))).alias("tokens"))


@query("""select p_partkey, [[lower(p_type)], ['wi'], ['fi'], [p_size::varchar], ['gb', 'gib', 'gigabyte', 'gigabytes'], ['television', 'televisions', 'tv', 'tvs'], ['pixma']] tokens from part""")
def a2_english_chain(spark, sf):
    words = F.concat("p_type", F.lit(" WiFi "), "p_size", F.lit("GB TVs Pixima"))
    found = A.analyze(words, "english")
    at = lambda k: F.transform(F.filter("found", lambda t: t["pos"] == k), lambda t: t["token"])
    return table(spark, sf, "part").select("p_partkey", found.alias("found")).select("p_partkey", F.array(*(at(k) for k in range(7))).alias("tokens"))


@query("select p_partkey, ['mss', (p_partkey + 100)::varchar, 'mss' || (p_partkey + 100)] tokens from part")
def a4_identifier_chain(spark, sf):
    return table(spark, sf, "part").select("p_partkey", A.identifier_match(F.concat(F.lit("MSS."), F.col("p_partkey") + 100, F.lit(".xml"))).alias("tokens"))


@query("select doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w != '' and w not in (" + ", ".join(f"'{w}'" for w in A.STOP_WORDS) + ")))) n from documents")
def a5_spelling_chain(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(A.spell_tokens(F.col("text"))).cast("long").alias("n"))


@query("""select p_partkey, flatten(list_transform([p_name, lower(p_type), p_name], lambda v, k: list_transform(string_split(v, ' '), lambda w, i: {'pos': i::int - 1 + 100 * (k::int - 1), 'token': w}))) tokens from part""")
def c3_value_gaps(spark, sf):
    return table(spark, sf, "part").select("p_partkey", A.analyze_values(F.array("p_name", "p_type", "p_name")).alias("tokens"))


@query("select p_partkey, regexp_replace(p_name, ' ', '-', 'g') || '-cafe-' || p_size \"name\" from part")
def f3_parameterize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.parameterize(F.concat(F.lit(" ("), F.initcap("p_name"), F.lit(") Café / "), "p_size", F.lit("!"))).alias("name"))


@query("select p_partkey, regexp_replace(p_name, ' ', '-', 'g') || case when p_size % 2 = 0 then '-a-b-c' else '' end id from part")
def f2_unicode_identifier(spark, sf):
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.lit(" Á b ç d.xml")).otherwise(F.lit(".XML")))
    return table(spark, sf, "part").select("p_partkey", S.require_identifier(S.identifier(F.lit(None).cast("string"), F.lit("–"), name)).alias("id"))


# --- derived fields


def derived(spark, sf):
    p = table(spark, sf, "part")
    return D.derive(p.select(
        F.col("p_partkey").cast("string").alias("id"), F.array(F.concat("p_name", F.lit(", 1901"))).alias("normalized_title_ssm"), F.array("p_brand").alias("places_ssim"), F.when(F.col("p_size") % 2 == 0, F.array("p_type")).alias("names_ssim"),
        F.array("p_brand").alias("collection_ssim"), F.array(F.concat(F.lit("A"), "p_size")).alias("unitid_ssm"), F.concat(F.lit("ead"), "p_partkey").alias("ead_ssi"),
    ))


@query("""select p_partkey::varchar id, [p_name || ', 1901', p_brand] || case when p_size % 2 = 0 then [p_type] else [] end || ['A' || p_size] "text", [p_name || ', 1901', p_brand] || case when p_size % 2 = 0 then [p_type] else [] end suggest,
 [p_partkey::varchar, 'ead' || p_partkey, 'A' || p_size] identifier_search, case when p_size % 2 = 0 then [p_type] else [] end name_teim, regexp_replace(p_name, '[^a-z0-9]', '', 'g') || '1901' title_sort from part""")
def c1_copied_fields(spark, sf):
    return derived(spark, sf).select("id", "text", "suggest", "identifier_search", "name_teim", "title_sort")


@query("select p_partkey::varchar id, ['a', p_size::varchar, 'a' || p_size] unitid_identifier_match, ['ead', p_partkey::varchar, 'ead' || p_partkey] ead_identifier_match from part")
def c7_identifier_fields(spark, sf):
    return derived(spark, sf).select("id", "unitid_identifier_match", "ead_identifier_match")


@query("select p_partkey::varchar id, [p_name || ', 1901'] normalized_title_ssm, [p_brand] places_ssim, case when p_size % 2 = 0 then [p_type] end names_ssim, [p_brand] collection_ssim, ['A' || p_size] unitid_ssm, 'ead' || p_partkey ead_ssi from part")
def p1_stored_fields(spark, sf):
    rows = derived(spark, sf).drop("unitid_identifier_match", "ead_identifier_match", "identifier_search")
    return D.stored(rows)


# --- harvest plans


def source_rows(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "resource").otherwise("archival_object")
    return o.select(
        F.concat(F.lit("/r/"), "o_orderkey").alias("uri"), kind.alias("primary_type"), F.array(kind, F.when(F.col("o_custkey") % 2 == 0, F.lit("pui")).otherwise(F.lit("staff"))).alias("types"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("ead_id"), (F.col("o_orderstatus") == "F").alias("publish"), (F.col("o_orderstatus") == "P").alias("suppressed"), F.col("o_orderdate").alias("system_mtime"),
    )


@query("select '/r/' || o_orderkey uri from orders where o_orderkey % 3 = 0 and o_custkey % 5 != 0")
def p12_contains(spark, sf):
    return source_rows(spark, sf).where(H.source_filter(contains=("ead_id",))).select("uri")


@query("select '/r/' || o_orderkey uri from orders where o_custkey % 2 = 0")
def p15_types(spark, sf):
    return source_rows(spark, sf).where(H.source_filter(primary_type=None, types="pui")).select("uri")


@query("select '/r/' || o_orderkey uri from orders where o_orderkey % 3 = 0 and o_orderstatus != 'P'")
def p14_strict_flags(spark, sf):
    return source_rows(spark, sf).where(H.source_filter(strict=True)).select("uri")


@query("""select n_nationkey, '{"query":{"jsonmodel_type":"boolean_query","op":"AND","subqueries":[{"field":"publish","value":true,"jsonmodel_type":"field_query","literal":true},{"field":"system_mtime","value":"2024-01-02","comparator":"greater_than","precision":"day","jsonmodel_type":"date_field_query"},{"field":"primary_type","value":"resource","jsonmodel_type":"field_query","literal":true},{"field":"ead_id","value":"*","jsonmodel_type":"field_query"},{"jsonmodel_type":"boolean_query","op":"AND","subqueries":[{"field":"uri","value":"/r/1","jsonmodel_type":"field_query","literal":true,"negated":true}]}]}}' plan from nation""")
def n2_source_plan(spark, sf):
    plan = H.source_plan(published=True, updated_after="2024-01-02", contains=("ead_id",), exclude={"uri": ["/r/1"]})
    return table(spark, sf, "nation").select("n_nationkey", F.lit(plan).alias("plan"))


@query("select n_nationkey id from nation where n_regionkey = 3 and (select count(*) from nation where n_regionkey = 3) between 1 and 100")
def m1_checked_deletes(spark, sf):
    indexed = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("ead_ssi"), "n_regionkey")
    return H.checked_deletes(R.stale(indexed, indexed.where("n_regionkey != 3"), "ead_ssi").select("id"), indexed)


@query("select o_orderkey uri from orders where o_orderdate >= timestamp '2001-06-01' or (select count(*) >= 900 from (select o_orderkey from orders where o_orderdate >= timestamp '2001-06-01'))")
def w4_changes_or_all(spark, sf):
    uris = table(spark, sf, "orders").select(F.col("o_orderkey").alias("uri"), "o_orderdate")
    own = uris.where("o_orderdate >= timestamp_ntz'2001-06-01'").select("uri")
    none = own.limit(0)
    return H.changes_or_all(own, none, none, uris.select("uri"))[0]


@query("select epoch(time_bucket(interval 5 minutes, ts))::bigint start, event_type, count(*) n from events group by all")
def w1_counts_by_window(spark, sf):
    rows = W.counts_by_window(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return rows.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


# --- exports and display rules


@query("select p_partkey, case when p_size % 5 = 0 then [] else case when p_size % 2 = 0 then [{'type': 'pdf', 'size': p_size}] else [] end || [{'type': 'ead', 'size': 9}] end files from part")
def k11_downloads(spark, sf):
    one = lambda kind, size: F.struct(F.lit(kind).alias("type"), size.cast("int").alias("size"))
    listed = F.array(one("ead", F.lit(9)), one("txt", F.lit(3)), one("pdf", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(0)))
    return table(spark, sf, "part").select("p_partkey", E.available_downloads(listed, F.col("p_size") % 5 == 0).alias("files"))


@query("select p_partkey dc_identifier, p_name dc_title, p_brand dc_creator, [p_type] dc_subject from part")
def p26_dublin_core(spark, sf):
    return E.dublin_core(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("normalized_title_ssm"), F.col("p_brand").alias("creator_ssim"), F.array("p_type").alias("access_subjects_ssim"), "p_size"))


@query("select event_id, 'export-' || strftime(ts, '%Y%m%d') || '.csv' \"name\" from events")
def k5_csv_name(spark, sf):
    return table(spark, sf, "events").select("event_id", S.csv_name("export", F.col("ts")).alias("name"))


@query("select n_nationkey, case when r_regionkey = 4 then '' else r_name end label from nation join region on n_regionkey = r_regionkey")
def x4_labels(spark, sf):
    names = table(spark, sf, "region").where("r_regionkey != 4").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("label"))
    return E.with_labels(table(spark, sf, "nation"), names, "n_regionkey", "label").select("n_nationkey", "label")


TAGS = ["scopecontent", "dsc", "did", "chronlist", "accessrestrict", "index"]


@query(f"select p_partkey, (case {TAGS!r}[p_size % 6 + 1] when 'did' then 1 when 'scopecontent' then 3 when 'accessrestrict' then 6 when 'index' then {len(E.SECTIONS) - 1} when 'dsc' then {len(E.SECTIONS)} end)::int place from part")
def x11_section_order(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.section_order(F.get(F.array(*map(F.lit, TAGS)), F.col("p_size") % 6)).alias("place"))


ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx"]


@query(f"select p_partkey, {ROMAN!r}[n] small, upper({ROMAN!r}[n]) large, n::varchar arabic, '•' bullet from (select p_partkey, p_partkey % 20 + 1 n from part)")
def x13_roman_numbers(spark, sf):
    n = (F.col("p_partkey") % 20 + 1).cast("int")
    mark = lambda style: E.list_number(n, F.lit(style))
    return table(spark, sf, "part").select("p_partkey", mark("lowerroman").alias("small"), mark("upperroman").alias("large"), mark("arabic").alias("arabic"), mark("disc").alias("bullet"))


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (select min(o_orderkey) from orders group by o_custkey)")
def j1_first_orders(spark, sf):
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("uri")).select("uri")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("uri"), "o_orderkey", "o_totalprice")
    return H.restrict(rows, first).select("o_orderkey", "o_totalprice")


# --- requests


@query("select p_partkey from part where list_has_any(string_split(p_name, ' '), ['small', 'ring']) and not regexp_matches(p_name, '(^| )bolts?( |$)')")
def q7_nested_boolean(spark, sf):
    tree = Q.parse("(small OR rings) AND NOT bolts")
    return table(spark, sf, "part").where(Q.matches(tree, A.analyze_one(F.col("p_name")))).select("p_partkey")


@query("select p_partkey from part where regexp_matches(p_name, '^..all ring$')")
def q10_wildcards(spark, sf):
    return table(spark, sf, "part").where(Q.matches(Q.parse('??all AND r*g AND "small rings"'), A.analyze_one(F.col("p_name")))).select("p_partkey")
