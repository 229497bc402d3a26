"""Tool-call linking: calls and results meet by identifier, are ordered by their dependencies, checked and serialised.

Calls and results are hash-joined on (conversation, identifier); no conversation is ever gathered into one task. A
call that names another one ("$ref" in its arguments, or depends_on) comes after it: levels are peeled off round by
round, and calls on a cycle are marked. Arguments are checked against the tool's schema, and each linked pair becomes
one canonical JSON text (keys sorted, no spaces). All steps are DataFrame operations.

Plain conversation turns take part as calls of the tool "reply": a user turn is the call turn:<n>, and the
assistant's turn n + 1 is its result. Turns whose text is a JSON object with tool_calls or tool_call_id bring their own.

Defined cases: turns with a null conversation or turn number are left out, and plain turns of roles other than user and
assistant, and calls without an identifier, give no row; a null or empty text is an empty prompt,
which fails validation; a call without a result, and a result without a call, keep a row of their own; equal rows
count once, and of different calls or results with one identifier the first by turn and content counts and the row
says duplicate; an unknown tool or malformed arguments are invalid; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

#: tool -> argument -> (type, required). Types: string, integer, number, boolean, object, array.
SCHEMAS = {
    "reply": {"prompt": ("string", True)},
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True)},
}
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
_TURN = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>,tool_call_id:string,content:string>"


def split_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, call_id, turn, name, arguments, depends_on) and results (conv_id, call_id, turn, content)."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("conv_id is not null and turn is not null")
    rows = rows.withColumn("own", F.when(F.col("text").startswith("{"), F.from_json("text", _TURN)))
    has_calls, has_result = F.col("own.tool_calls").isNotNull(), F.col("own.tool_call_id").isNotNull()
    given = rows.where(has_calls).select("conv_id", "turn", F.explode("own.tool_calls").alias("c")).where("c.id is not null")
    given = given.select("conv_id", F.col("c.id").alias("call_id"), "turn", F.coalesce("c.name", F.lit("")).alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    plain = rows.where(~F.coalesce(has_calls | has_result, F.lit(False)))
    asked = plain.where("role = 'user'").select("conv_id", F.concat(F.lit("turn:"), F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"), F.array().cast("array<string>").alias("depends_on"))
    told = rows.where(has_result).select("conv_id", F.col("own.tool_call_id").alias("call_id"), "turn", F.coalesce("own.content", F.lit("")).alias("content"))
    answered = plain.where("role = 'assistant'").select("conv_id", F.concat(F.lit("turn:"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return given.unionByName(asked), told.unionByName(answered)


def argument_errors(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Sorted, comma-joined faults; an empty string for valid arguments."""
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    by_tool = F.lit("unknown tool")
    for tool, fields in sorted(schemas.items()):
        faults = []
        for field, (kind, required) in sorted(fields.items()):
            at = F.try_variant_get(value, f"$['{field}']", "variant")
            found = F.schema_of_variant(at)
            if required:
                faults.append(F.when(at.isNull() | (found == "VOID"), f"{field} missing"))
                if kind == "string":
                    faults.append(F.when(F.try_variant_get(value, f"$['{field}']", "string") == "", f"{field} empty"))
            faults.append(F.when(at.isNotNull() & (found != "VOID") & ~found.rlike(f"^({_KINDS[kind]})$"), f"{field} not {kind}"))
        extra = F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*map(F.lit, sorted(fields))) if fields else F.array().cast("array<string>"))
        faults.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(extra), " "))))
        by_tool = F.when(name == tool, F.concat_ws(",", *faults)).otherwise(by_tool)
    return F.when(~is_object, F.lit("arguments are no object")).otherwise(by_tool)


def levels_of(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level): 0 without dependencies, else one more than the highest of them; -1 on or behind a cycle.

    Rounds are as many as the longest chain; each is a join on identifiers over the calls that are still open.
    """
    refs = F.array_union("depends_on", F.regexp_extract_all("arguments", F.lit(r'"\$ref"\s*:\s*"([^"]+)"'), F.lit(1)))
    keys = calls.select("conv_id", "call_id")
    edges = calls.where((F.size("depends_on") > 0) | F.col("arguments").contains('"$ref"')).select("conv_id", "call_id", F.explode(F.array_distinct(refs)).alias("needs"))
    edges = scratch.save(edges.join(keys.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi"), "edges")
    if edges.isEmpty():
        return keys.withColumn("level", F.lit(0))
    done = scratch.save(keys.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "done0")
    ready, open_edges, k = done, edges, 0
    while not ready.isEmpty():
        k += 1
        met = ready.select("conv_id", F.col("call_id").alias("needs"))
        left = scratch.save(open_edges.join(met, ["conv_id", "needs"], "left_anti"), f"open{k}")
        ready = scratch.save(open_edges.select("conv_id", "call_id").distinct().join(left, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(k)), f"ready{k}")
        done, open_edges = done.unionByName(ready), left
    return done.unionByName(open_edges.select("conv_id", "call_id").distinct().withColumn("level", F.lit(-1)))


def _once(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of each identifier and how many different ones there are."""
    return rows.distinct().groupBy("conv_id", "call_id").agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n")).select("conv_id", "call_id", "first.*", "n")


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row for each identifier: conv_id, call_id, level, call_turn, result_turn, tool, status, errors, record."""
    scratch = Scratch(calls.sparkSession, "toolcalls")
    calls = _once(calls, "turn", "name", "arguments", "depends_on")
    results = _once(results, "turn", "content").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.col("n").alias("n_results"))
    both = calls.join(levels_of(calls, scratch), ["conv_id", "call_id"], "left").join(results, ["conv_id", "call_id"], "full_outer")
    status = (
        F.when(F.col("turn").isNull(), "orphan result").when(F.col("level") < 0, "cycle").when(F.col("result_turn").isNull(), "unanswered")
        .when((F.col("n") > 1) | (F.col("n_results") > 1), "duplicate").when(F.col("result_turn") <= F.col("turn"), "answered before asked").otherwise("linked")
    )
    sorted_args = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.col("arguments").alias("malformed"))))
    # Keys in alphabetical order; the arguments are a value of their own.
    head, tail = F.to_json(F.struct(F.col("call_id").alias("id"), F.coalesce("name", F.lit("")).alias("name"))), F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("result"), "status"))
    record = F.concat(F.lit('{"arguments":'), F.when(F.col("turn").isNull(), "{}").otherwise(sorted_args), F.lit(","), head.substr(F.lit(2), F.length(head) - 2), F.lit(","), tail.substr(F.lit(2), F.length(tail)))
    out = both.withColumn("status", status)
    return out.select("conv_id", "call_id", "level", F.col("turn").alias("call_turn"), "result_turn", F.col("name").alias("tool"), "status", F.when(F.col("turn").isNotNull(), argument_errors(F.col("name"), F.col("arguments"), schemas)).alias("errors"), record.alias("record"))


def link_conversations(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    return link(*split_turns(turns), schemas)


#: The same rows as DuckDB SQL over a conversations table of plain turns.
ORACLE_SQL = """
with t as (select conv_id, turn, role, coalesce(text, '') text from conversations where conv_id is not null and turn is not null),
c as (select conv_id, 'turn:' || turn call_id, min(turn) turn, min(text) prompt, count(*) n from (select distinct conv_id, turn, text from t where role = 'user') group by 1, 2),
r as (select conv_id, 'turn:' || (turn - 1) call_id, min(turn) result_turn, min(text) content, count(*) n_results from (select distinct conv_id, turn, text from t where role = 'assistant') group by 1, 2),
b as (select coalesce(c.conv_id, r.conv_id) conv_id, coalesce(c.call_id, r.call_id) call_id, case when c.turn is not null then 0 end level, c.turn call_turn, result_turn, case when c.turn is not null then 'reply' end tool,
  case when c.turn is null then 'orphan result' when result_turn is null then 'unanswered' when n > 1 or n_results > 1 then 'duplicate' else 'linked' end status,
  case when c.turn is null then null when prompt = '' then 'prompt empty' else '' end errors, prompt, content
  from c full outer join r on c.conv_id = r.conv_id and c.call_id = r.call_id)
select conv_id, call_id, level, call_turn, result_turn, tool, status, errors,
  '{"arguments":' || case when call_turn is null then '{}' else '{"prompt":' || to_json(prompt)::varchar || '}' end || ',"id":' || to_json(call_id)::varchar || ',"name":' || to_json(coalesce(tool, ''))::varchar
  || ',"result":' || to_json(coalesce(content, ''))::varchar || ',"status":' || to_json(status)::varchar || '}' record
from b"""
