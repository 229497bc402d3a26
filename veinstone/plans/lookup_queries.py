"""Queries of lookups, records, plans and clocks over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import harvest as H, lookups as L
from .catalog import query, table


@query("select lower(n_name) code, n_nationkey uri, null::varchar shoulder from nation")
def h1_sliced_records(spark, sf):
    return L.sliced(table(spark, sf, "nation"), {"code": "n_name", "uri": "n_nationkey", "shoulder": "ark_shoulder"})


@query("select o_custkey \"key\", arg_max(o_orderkey, o_orderkey) \"value\" from orders group by 1")
def h2_last_pairs(spark, sf):
    return L.pairs(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderkey")


@query("select o_orderkey, case when length(n) > 250 then regexp_replace(substr(n, 1, 250), '\\s\\S*$', '') || ' more' else n end note from (select o_orderkey, repeat('note of ' || o_orderpriority || ' ', (o_orderkey % 30)::int) || ' end' n from orders)")
def f17_restrictions_with_link(spark, sf):
    words = F.concat(F.lit("note of "), "o_orderpriority", F.lit(" "))
    notes = F.array(F.repeat(words, (F.col("o_orderkey") % 30).cast("int")), F.lit("end"))
    return table(spark, sf, "orders").select("o_orderkey", L.restrictions(notes, " more").alias("note"))


@query("""select o_orderkey, '{"query":{"jsonmodel_type":"boolean_query","op":"AND","subqueries":[{"field":"publish","value":true,"jsonmodel_type":"field_query","literal":true},{"field":"system_mtime","value":"' || strftime(o_orderdate, '%Y-%m-%d')
 || '","comparator":"greater_than","precision":"day","jsonmodel_type":"date_field_query"},{"field":"primary_type","value":"' || o_orderpriority || '","jsonmodel_type":"field_query","literal":true}]}}' aq from orders""")
def n2_plans_by_row(spark, sf):
    """Each row's own plan: the day after which changes are asked for and the type come from its columns."""
    return table(spark, sf, "orders").select("o_orderkey", H.source_plan_of(F.to_date("o_orderdate"), F.col("o_orderpriority"), published=True).alias("aq"))


@query("select c_custkey, n_name repository_n_name from customer left join nation on n_name = 'NATION_' || (c_custkey % 30) or n_nationkey = try_cast('x' as bigint)")
def j2_repository_by_name(spark, sf):
    docs = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_custkey") % 30).alias("name"))
    return L.with_repository(docs, table(spark, sf, "nation").select("n_name"), "name", ("n_name",)).select("c_custkey", "repository_n_name")


@query("""select event_id, strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') + interval 8 hour opens from events where event_id % 3 != 0""")
def t6_parsed_hours(spark, sf):
    """The opening time of a feed's only entry, which comes with an offset of eight hours."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    feed = F.concat(F.lit('{"data":{"attributes":{"hours":[{"opens_at":"'), at, F.lit('-08:00","closes_at":"'), at, F.lit('-08:00","open":true}]}}}'))
    hours = T.parse_hours(F.when(F.col("event_id") % 3 != 0, feed))
    return table(spark, sf, "events").select("event_id", F.get(hours, F.lit(0))["opens_at"].cast("timestamp_ntz").alias("opens")).where("opens is not null")


@query("select event_id, case when event_id % 4 = 0 then null else ts end opens, event_id % 3 = 0 as \"open\" from events")
def t3_hours_today(spark, sf):
    """The first entry of a day, open or not; none where a note says that it is closed."""
    at = F.col("ts").cast("timestamp")
    entry = F.array(F.struct((F.col("event_id") % 3 == 0).alias("open"), at.alias("opens_at"), at.alias("closes_at")))
    today = T.hours_today(entry, F.when(F.col("event_id") % 4 == 0, "closed"))
    return table(spark, sf, "events").select("event_id", today["opens_at"].cast("timestamp_ntz").alias("opens"), (F.col("event_id") % 3 == 0).alias("open"))
