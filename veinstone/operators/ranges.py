"""Histograms of year ranges by a sweep: one count up where a range starts, one down behind its end, and a running sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def runs(years: Column) -> Column:
    """Array of (begin, end) of the runs of neighbouring years in a list, in order."""
    sorted_years = F.array_sort(F.array_distinct(F.array_compact(years)))
    kind = "array<struct<begin:int,end:int>>"

    def add(acc: Column, y: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["begin"].alias("begin"), y.alias("end"))))
        fresh = F.concat(acc, F.array(F.struct(y.alias("begin"), y.alias("end"))))
        return F.when(F.size(acc) == 0, fresh).when(last["end"] + 1 == y, grown).otherwise(fresh)

    return F.aggregate(F.transform(sorted_years, lambda y: y.cast("int")), F.array().cast(kind), add)


def segments(begin: Column, end: Column, low: int, width: int) -> tuple[Column, Column]:
    """Numbers of the first and last segment that a range touches."""
    number = lambda y: F.floor((y - low) / width).cast("long")
    return number(begin), number(end)


def range_facet(docs: DataFrame, begin: str, end: str, low: int, high: int, width: int = 1) -> DataFrame:
    """(begin, end, count): for each segment of `width` years from low to high the number of rows whose range touches it,
    zeros included. Ranges are cut to low and high; rows without a range or outside do not count. No range is expanded: the
    rows are added up by their first and by their last segment, and the sum runs over the segments."""
    some = docs.where(F.col(begin).isNotNull() & F.col(end).isNotNull() & (F.col(begin) <= F.col(end)) & (F.col(begin) <= high) & (F.col(end) >= low))
    first, last = segments(F.greatest(F.col(begin), F.lit(low)), F.least(F.col(end), F.lit(high)), low, width)
    up = some.groupBy(first.alias("segment")).agg(F.count(F.lit(1)).alias("change"))
    down = some.groupBy((last + 1).alias("segment")).agg((-F.count(F.lit(1))).alias("change"))
    n = (high - low) // width + 1
    each = docs.sparkSession.range(n).select(F.col("id").alias("segment"), F.lit(0).cast("long").alias("change"))
    sums = up.unionByName(down).unionByName(each).groupBy("segment").agg(F.sum("change").alias("change"))
    # One row for each segment.
    running = sums.withColumn("count", F.sum("change").over(Window.orderBy("segment"))).where(F.col("segment") < n)
    at = F.col("segment") * width + low
    return running.select(at.cast("int").alias("begin"), F.least(at + width - 1, F.lit(high)).cast("int").alias("end"), "count")


def years_facet(docs: DataFrame, field: str, low: int, high: int, width: int = 1) -> DataFrame:
    """range_facet() of a list of years: its runs are counted, and a row that touches a segment with several runs counts once."""
    number = lambda y: F.floor((y - low) / width).cast("int")
    touched = F.transform(F.filter(F.col(field), lambda y: (y >= low) & (y <= high)), number)
    pieces = docs.select(F.explode(runs(touched)).alias("r")).select("r.begin", "r.end")
    out = range_facet(pieces, "begin", "end", 0, (high - low) // width)
    return out.select((F.col("begin") * width + low).alias("begin"), F.least(F.col("end") * width + low + width - 1, F.lit(high)).alias("end"), "count")
