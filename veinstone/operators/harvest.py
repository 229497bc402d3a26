"""Harvest planning: source queries as filters and as JSON plans, change capture, and safeguards."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

MOST_URIS, MOST_DELETES, OVERLAP_DAYS = 900, 100, 2
#: Rows that a task of a large join gets.
TASK_ROWS = 1 << 20


class TooManyUris(ValueError):
    """More values than one source request can carry."""


def check_uris(n: int, most: int = MOST_URIS) -> None:
    if n >= most:
        raise TooManyUris(f"{n} uris; fewer than {most} are possible")


def check_deletes(delete_count: int, index_count: int, most: int = MOST_DELETES) -> None:
    """Both checks hold: not too many, and not everything."""
    if delete_count > most:
        raise ValueError(f"{delete_count} deletes are more than {most}")
    if delete_count >= index_count:
        raise ValueError("every indexed document would be deleted")


def checked_deletes(stale: DataFrame, indexed: DataFrame, most: int = MOST_DELETES) -> DataFrame:
    """The rows to delete, once both checks of check_deletes() hold; no more than most + 1 rows of either are counted."""
    n = stale.limit(most + 1).count()
    if n:
        check_deletes(n, indexed.limit(most + 1).count(), most)
    return stale


def source_filter(primary_type: str | None = "resource", types: str | None = None, published: bool = False, suppressed: bool = False, strict: bool = False, updated_after: str | None = None, contains: tuple[str, ...] = (), exclude: dict[str, list] | None = None, uris: list[str] | None = None) -> Column:
    """The AND of the clauses that are asked for.

    A false flag asks for nothing, unless strict; an empty uri list matches nothing; excluded values keep rows without
    the field.
    """
    clauses: list[Column] = []
    if suppressed or strict:
        clauses.append(F.col("suppressed") == F.lit(bool(suppressed)))
    if published:
        clauses.append(F.col("publish"))
    if updated_after:
        clauses.append(F.to_date("system_mtime") > F.to_date(F.lit(updated_after)))
    if primary_type:
        clauses.append(F.col("primary_type") == primary_type)
    if types:
        clauses.append(F.array_contains("types", types))
    if uris is not None:
        clauses.append(F.col("uri").isin(*uris) if uris else F.lit(False))
    clauses += [F.col(f).isNotNull() for f in contains]
    for field, values in (exclude or {}).items():
        if values:
            clauses.append(~F.coalesce(F.col(field).isin(*values), F.lit(False)))
    out = F.lit(True)
    for c in clauses:
        out = out & c
    return out


def source_plan(primary_type: str | None = "resource", published: bool = False, updated_after: str | None = None, contains: tuple[str, ...] = (), exclude: dict[str, list] | None = None, uris: list[str] | None = None) -> str:
    """The same query as the source's JSON boolean tree, keys in the source's order."""
    leaf = lambda field, value, **more: {"field": field, "value": value, "jsonmodel_type": "field_query"} | more
    tree = lambda op, parts: {"jsonmodel_type": "boolean_query", "op": op, "subqueries": parts}
    parts = []
    if published:
        parts.append(leaf("publish", True, literal=True))
    if updated_after:
        parts.append({"field": "system_mtime", "value": updated_after, "comparator": "greater_than", "precision": "day", "jsonmodel_type": "date_field_query"})
    if primary_type:
        parts.append(leaf("primary_type", primary_type, literal=True))
    if uris is not None:
        parts.append(tree("OR", [leaf("uri", u, literal=True) for u in uris]))
    parts += [leaf(f, "*") for f in contains]
    for field, values in (exclude or {}).items():
        if values:
            parts.append(tree("AND", [leaf(field, v, literal=True, negated=True) for v in values]))
    return json.dumps({"query": tree("AND", parts)}, separators=(",", ":"))


def source_plan_of(updated_after: Column, primary_type: Column, published: bool = False, suppressed: Column | None = None) -> Column:
    """The plan as a column, with each row's own day and type; a null day or type asks for nothing."""
    leaf = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit("field_query").alias("jsonmodel_type"), F.lit(True).alias("literal"))
    day = F.struct(F.lit("system_mtime").alias("field"), F.date_format(updated_after, "yyyy-MM-dd").alias("value"), F.lit("greater_than").alias("comparator"), F.lit("day").alias("precision"), F.lit("date_field_query").alias("jsonmodel_type"))
    parts = []
    if suppressed is not None:
        parts.append(F.when(suppressed.isNotNull(), F.to_json(leaf("suppressed", suppressed))))
    if published:
        parts.append(F.to_json(leaf("publish", F.lit(True))))
    parts += [F.when(updated_after.isNotNull(), F.to_json(day)), F.when(primary_type.isNotNull(), F.to_json(leaf("primary_type", primary_type)))]
    return F.concat(F.lit('{"query":{"jsonmodel_type":"boolean_query","op":"AND","subqueries":['), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("]}}"))


def updated_since(last_run: Column, overlap: int = OVERLAP_DAYS) -> Column:
    """The day after which changes are asked for: runs overlap, and what comes twice replaces itself."""
    return F.date_sub(F.to_date(last_run), overlap)


def restrict(rows: DataFrame, uris: DataFrame) -> DataFrame:
    """Rows whose uri is listed; a list of any size is a semi-join."""
    return rows.join(uris.select("uri"), "uri", "left_semi")


def exclude(rows: DataFrame, uris: DataFrame) -> DataFrame:
    """Rows whose uri is not listed, and rows without one."""
    return rows.join(uris.select("uri"), "uri", "left_anti")


def parents_of(components: DataFrame) -> DataFrame:
    """The distinct resources of changed components."""
    return components.where("resource is not null").select(F.col("resource").alias("uri")).distinct()


def linked_resources(agents: DataFrame, agent_links: DataFrame, record_parents: DataFrame) -> DataFrame:
    """Resources that name changed agents, directly or through one of their records.

    agents (agent), agent_links (agent, record), record_parents (record, resource); a record of its own is a resource.
    Large tables are dealt to tasks of about TASK_ROWS rows, so that what a task sorts does not grow with them.
    """
    records = agent_links.join(agents, "agent", "left_semi").select("record")
    n = record_parents.count() // TASK_ROWS + 1  # for files, from their footers
    if n > int(agents.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        records, record_parents = records.repartition(n, "record"), record_parents.repartition(n, "record")
    through = record_parents.join(records, "record", "left_semi").select(F.col("resource").alias("uri"))
    return through.union(records.join(record_parents, "record", "left_anti").select(F.col("record").alias("uri"))).distinct()


def changes(own: DataFrame, by_component: DataFrame, by_agent: DataFrame, dedupe: bool = True) -> DataFrame:
    """Uris to fetch again. With dedupe off, a uri that two later paths find stays twice."""
    known = own.select("uri")
    later = [c.select("uri").join(known, "uri", "left_anti") for c in (by_component, by_agent)]
    out = known.unionByName(later[0]).unionByName(later[1])
    return out.distinct() if dedupe else out


def changes_or_all(own: DataFrame, by_component: DataFrame, by_agent: DataFrame, everything: DataFrame, most: int = MOST_URIS) -> tuple[DataFrame, bool]:
    """The changes, or everything where the source could not take the list; the flag says which."""
    listed = own.select("uri").unionByName(by_component.select("uri")).unionByName(by_agent.select("uri"))
    n = listed.distinct().limit(most).count()  # all three lists travel; a bounded probe
    try:
        check_uris(n, most)
        return changes(own, by_component, by_agent), False
    except TooManyUris:
        return own.select("uri").unionByName(everything.select("uri").join(own.select("uri"), "uri", "left_anti")).distinct(), True


def quarantine(rows: DataFrame, name: Column, code: Column, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be fetched, and those without a name or with an unknown repository, with the reason."""
    marked = rows.withColumns({"file_name": name, "code": code}).join(codes.select(F.col("code").alias("_known")).distinct(), F.col("code") == F.col("_known"), "left")
    why = F.when(F.col("file_name").isNull(), "no identifier").when(F.col("_known").isNull(), "unknown repository")
    marked = marked.withColumn("reason", why).drop("_known")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def idle_guests(users: DataFrame, bookmarks: DataFrame, before: Column) -> DataFrame:
    """Guests without bookmarks that have not changed since."""
    return users.where(F.col("guest") & (F.col("updated_at") < before)).join(bookmarks.select(F.col("user_id").alias("id")), "id", "left_anti")
