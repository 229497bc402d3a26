"""Queries of hierarchies, year ranges and cursors over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import cursors as C, export as E, intervals as I, networks as N, ranges as Y
from .catalog import query, table

#: Orders as collections, and their lines as components of three levels, in pre-order.
NESTED = "t as (select o_orderkey * 100 id, o_orderkey r, 0 p, 0 l from orders union select l_orderkey * 100 + l_linenumber, l_orderkey, l_linenumber, 1 + (l_linenumber - 1) % 3 from lineitem)"
ENDED = f"{NESTED}, e as (select a.*, coalesce((select min(b.p) from t b where b.r = a.r and b.p > a.p and b.l <= a.l) - 1, (select max(b.p) from t b where b.r = a.r)) z from t a)"


def nested(spark, sf) -> DataFrame:
    number = F.col("l_linenumber").cast("int")
    tops = table(spark, sf, "orders").select((F.col("o_orderkey") * 100).alias("id"), F.col("o_orderkey").alias("_root_"), F.lit(0).alias("sort_isi"), F.lit(0).alias("component_level_isim"))
    return tops.unionByName(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 100 + number).alias("id"), F.col("l_orderkey").alias("_root_"), number.alias("sort_isi"), (1 + (number - 1) % 3).alias("component_level_isim")).distinct())


@query(f"with {ENDED} select id, z::bigint \"last\" from e")
def j9_intervals(spark, sf):
    return I.with_intervals(nested(spark, sf)).select("id", F.col(I.LAST).alias("last"))


@query(f"with {ENDED} select x.id::varchar id, list(a.id::varchar order by a.p) path from e x join e a on a.r = x.r and a.p <= x.p and a.z >= x.p group by x.id")
def j9_interval_paths(spark, sf):
    return I.paths(nested(spark, sf))


@query(f"with {ENDED} select a.id, a.p::int \"at\" from e a where a.r = (select min(o_orderkey) from orders) and a.p < 3 and a.z >= 3")
def j9_ancestors_of_one(spark, sf):
    docs = I.with_intervals(nested(spark, sf))
    first = table(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]
    return I.ancestors_at(first, 3, docs).select("id", F.col("sort_isi").alias("at"))


@query(f"with {ENDED} select a.id from e a join e s on s.r = a.r and s.p = 1 where a.r = (select min(o_orderkey) from orders) and a.p > 1 and a.p <= s.z")
def j10_descendants(spark, sf):
    docs = I.with_intervals(nested(spark, sf))
    first = table(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]
    top = docs.where((F.col("_root_") == first) & (F.col("sort_isi") == 1)).select(I.LAST).first()
    return I.descendants(docs, first, 1, top[0] if top else 0).select("id")


@query(f"with {ENDED} select c.id, s.p::int top, (c.l - s.l)::int below from e s join e c on c.r = s.r and c.p > s.p and c.p <= s.z where s.l = 1 and c.l - s.l <= 2")
def x12_deep_contents(spark, sf):
    """The table of contents below each series, two levels deep."""
    docs = I.with_intervals(nested(spark, sf))
    series = docs.where("component_level_isim = 1").select(F.col("_root_").alias("block"), F.col("sort_isi").alias("at"), F.col(I.LAST).alias("last"), F.col("component_level_isim").alias("top_level"))
    return I.contents(docs, series, 2).select("id", "top", "below")


SPANS = "s as (select year(o_orderdate)::int a, (year(o_orderdate) + o_custkey % 3000)::int z from orders)"


@query(f"with {SPANS}, g as (select unnest(range(1900, 4001, 100))::int b) select b \"begin\", least(b + 99, 4000)::int \"end\", (select count(*) from s where a <= least(b + 99, 4000) and z >= b) \"count\" from g")
def g4_long_ranges(spark, sf):
    start = F.year("o_orderdate")
    docs = table(spark, sf, "orders").select(start.alias("a"), (start + F.col("o_custkey") % 3000).cast("int").alias("z"))
    return Y.range_facet(docs, "a", "z", 1900, 4000, 100)


LISTS = "s as (select o_orderkey k, case when o_orderkey % 4 > 0 then [year(o_orderdate)::int, (year(o_orderdate) + 1)::int, (year(o_orderdate) + 3 * (o_orderkey % 4))::int] end as years from orders)"


@query(f"with {LISTS}, g as (select unnest(range(1990, 2011, 2))::int b) select b \"begin\", least(b + 1, 2010)::int \"end\", (select count(*) from s where len(list_filter(years, lambda y: y between b and least(b + 1, 2010))) > 0) \"count\" from g")
def g4_year_lists(spark, sf):
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 4
    docs = table(spark, sf, "orders").select(F.when(k > 0, F.array(y, y + 1, (y + 3 * k).cast("int"))).alias("years"))
    return Y.years_facet(docs, "years", 1990, 2010, 2)


@query(f"with {LISTS}, r as (select k, unnest(list_sort(list_distinct(years))) y from s), i as (select k, y, y - row_number() over (partition by k order by y) g from r) select k, min(y)::int \"begin\", max(y)::int \"end\" from i group by k, g")
def p9_year_runs(spark, sf):
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 4
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(k > 0, F.array(y, y + 1, (y + 3 * k).cast("int"))).alias("years"))
    return docs.select("k", F.explode(Y.runs(F.col("years"))).alias("r")).select("k", "r.begin", "r.end")


@query("select o_orderkey id from (select o_orderkey, row_number() over (order by o_orderpriority, o_orderdate desc, o_orderkey) n from orders) where n between 501 and 750")
def s11_third_page(spark, sf):
    """The third page of 250 rows, by the cursors of the first two."""
    keys = [("o_orderpriority", "asc"), ("o_orderdate", "desc"), ("o_orderkey", "asc")]
    orders, cursor = table(spark, sf, "orders").select("o_orderpriority", "o_orderdate", "o_orderkey"), None
    for _ in range(2):
        page = C.page_after(orders, keys, cursor).collect()
        cursor = C.encode(page[-1], keys)
    return C.page_after(orders, keys, cursor).select(F.col("o_orderkey").alias("id"))


# --- networks

#: Networks of nations, of both kinds and overlapping, and a malformed one.
NETWORKS = "case n_nationkey % 5 when 0 then '10.' || n_nationkey || '.0.0/16' when 1 then '10.' || (n_nationkey // 2) || '.' || n_nationkey || '.0/24' when 2 then 'fd00:' || n_nationkey || '::/32' when 3 then '10.0.0.0/8' else 'x/8' end"


@query(f"""with n as (select distinct {NETWORKS} net from nation), c as (select c_custkey k, (c_custkey % 30)::int a, (c_custkey % 40)::int b, c_custkey % 2 = 0 old from customer),
 m as (select k, net, case when net like '%/24' then 24 when net like '%/16' then 16 when net like '10%/8' then 8 else 32 end bits from c, n
  where old and net like '10.%' and (net = '10.0.0.0/8' or net = '10.' || a || '.0.0/16' or net = '10.' || a || '.' || b || '.0/24') or not old and net = 'fd00:' || a || '::/32')
 select c.k c_custkey, arg_max(net, bits) network from c left join m using (k) group by 1""")
def p30_longest_prefix(spark, sf):
    k = F.col("c_custkey")
    text = lambda n: (k % n).cast("string")
    customers = table(spark, sf, "customer").select("c_custkey", F.when(k % 2 == 0, F.concat(F.lit("10."), text(30), F.lit("."), text(40), F.lit(".7"))).otherwise(F.concat(F.lit("fd00:"), text(30), F.lit("::"), text(40))).alias("address"))
    n = F.col("n_nationkey").cast("int")
    word = n.cast("string")
    net = F.when(n % 5 == 0, F.concat(F.lit("10."), word, F.lit(".0.0/16"))).when(n % 5 == 1, F.concat(F.lit("10."), F.floor(n / 2).cast("string"), F.lit("."), word, F.lit(".0/24"))).when(n % 5 == 2, F.concat(F.lit("fd00:"), word, F.lit("::/32"))).when(n % 5 == 3, F.lit("10.0.0.0/8")).otherwise("x/8")
    return N.longest_prefix(customers, "address", table(spark, sf, "nation").select(net.alias("net")), "net").select("c_custkey", "network")


# --- list numbers

ROMAN = "array_to_string([repeat('c', n // 100), ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1], ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1]], '')"


@query(f"with p as (select p_partkey, p_partkey % 200 + 1 n from part) select p_partkey, {ROMAN} roman, case when n > 26 then chr((96 + (n - 1) // 26)::int) else '' end || chr((97 + (n - 1) % 26)::int) letter from p")
def x13_long_lists(spark, sf):
    n = (F.col("p_partkey") % 200 + 1).cast("int")
    return table(spark, sf, "part").select("p_partkey", E.list_number(n, F.lit("lowerroman")).alias("roman"), E.list_number(n, F.lit("loweralpha")).alias("letter"))
