"""The trie of conversation prefixes, by prefix-doubling names.

1. Turns are ranked by a range sort of all turns, so that one long conversation spans several tasks, and rebuilt.
2. Blocks of 1, 2, 4, ... turns at multiples of their length get dense names: a block's name stands for the pair of its
   halves' names, so each doubling is one round of joins, and the rounds grow with the logarithm of the longest conversation.
3. A prefix of d turns is composed of the blocks of d's binary digits, the largest first. Prefixes whose lowest digit is the
   same are named in one round. Equal names of one depth are one node, known by its smallest conversation and its depth.
4. Sums over subtrees double their reach as well: what is known of nodes less than 2^k below is added to the node 2^k above.

Names that many rows bear are joined by broadcast (joins.join_counted), so no name's rows gather in one task.

Null roles and texts count as empty, rows without a conversation are left out, turns of equal number come in the order of
role and text, and repeated rows are turns of their own. Texts of any length enter as digests (SHA-256 of role and text).
A conversation without turns is an end at the root. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import join_counted
from .scratch import Scratch

#: Bytes of conversation numbers in one row on the way to a node's digest.
CHUNK = 4096


def dense_names(rows: DataFrame, keys: list[str], scratch: Scratch, label: str) -> tuple[DataFrame, dict]:
    """(keys, name, rep, n_rows) with names from 0 without gaps, the smallest conversation and the number of rows; the total and the most of these."""
    groups = rows.groupBy(*keys).agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n_rows")).withColumn("id", F.monotonically_increasing_id())
    stored, seen = scratch.save_measured(groups, label, F.sum("n_rows").alias("total"), F.max("n_rows").alias("most"))
    part = F.shiftright("id", 33).alias("part")
    # One row for each partition of the stored table.
    sizes = stored.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    named = stored.withColumn("part", part).join(F.broadcast(before), "part")
    return named.select(*keys, (F.col("before") + F.col("id") - F.shiftleft("part", 33)).alias("name"), "rep", "n_rows"), seen


def head_turns(conv: Column) -> Column:
    """How many turns a conversation takes from another one."""
    return F.crc32(conv.cast("string")) % 9


def numbered_turns(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, turn, size): each turn with its place from 0, its digest and its text's bytes; (conv, n) turns of each."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *text).where("conv is not null")
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "given"]
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    placed = rows.withColumn("given", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    stored = scratch.save(placed.select("conv", digest.alias("turn"), F.octet_length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("id")), "turns")
    stored = stored.withColumn("part", F.shiftright("id", 33))
    parts = stored.groupBy("conv", "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.save(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "starts")
    pos = F.col("before") + F.col("id") - F.col("first")
    return stored.join(starts.drop("n"), ["conv", "part"]).select("conv", pos.alias("pos"), "turn", "size"), starts.groupBy("conv").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, dict]:
    """(conv, pos, turn, size) of the rebuilt conversations; (conv, n_rebuilt) of all; their measures."""
    own, sizes = numbered_turns(turns, scratch)
    base = F.col("conv") - F.col("conv") % 5
    taken = F.least("head", F.coalesce("n_base", F.lit(0)))
    facts = sizes.select("conv", "n", head_turns(F.col("conv")).alias("head"), base.alias("base")).join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    facts = facts.select("conv", "n", "head", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("n_rebuilt"))
    convs, seen = scratch.save_measured(facts, "convs", F.min("conv").alias("first"), F.count(F.lit(1)).alias("n_convs"), F.sum("n").alias("n_turns"), F.max("n_rebuilt").alias("depth"), F.max("n").alias("most"))
    kept = join_counted(own, convs.select("conv", "n", "head", "taken"), ["conv"], seen["n_turns"], seen["most"], "n").where("pos >= head").select("conv", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "turn", "size")
    least, most = F.lit(-(2**63) + 4), F.lit(2**63 - 5)
    near = F.sequence(F.greatest("conv", least) - 4, F.least("conv", most) + 4)
    heads = own.where((F.col("conv") % 5 == 0) & (F.col("pos") < 8)).select(F.col("conv").alias("from"), "pos", "turn", "size", F.explode(near).alias("conv")).where(F.col("from") == base)
    heads = heads.join(convs.select("conv", "head"), "conv").where("pos < head").select("conv", "pos", "turn", "size")
    return scratch.save(kept.unionByName(heads), "rebuilt"), convs.select("conv", "n_rebuilt"), seen


def blocks(turns: DataFrame, depth: int, scratch: Scratch) -> list[DataFrame]:
    """For each k, (conv, i, name): the names of the blocks of 2^k turns that start at i * 2^k."""
    out, rows = [], turns.select("conv", F.col("pos").alias("i"), "turn")
    for k in range(depth.bit_length()):
        if k:
            half = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
            rows = scratch.save(out[-1].groupBy("conv", F.shiftright("i", 1).alias("i2")).agg(half(0).alias("a"), half(1).alias("b")).where("b is not null").withColumnRenamed("i2", "i"), f"pairs{k}")
        keys = ["a", "b"] if k else ["turn"]
        names, seen = dense_names(rows, keys, scratch, f"names{k}")
        out.append(scratch.save(join_counted(rows, names.drop("rep"), keys, seen["total"], seen["most"]).select("conv", "i", "name"), f"blocks{k}"))
    return out


def prefixes(levels: list[DataFrame], scratch: Scratch) -> tuple[DataFrame | None, DataFrame | None]:
    """(conv, d, name, rep) for each prefix of d turns; (d, rep, n_convs) of each node."""
    done: list[DataFrame] = []
    nodes: list[DataFrame] = []
    for k in reversed(range(len(levels))):
        size = 1 << k
        rows = levels[k].where("i % 2 = 0").select("conv", (F.col("i") * size).alias("start"), F.col("name").alias("b"))
        known = reduce(DataFrame.unionByName, done).select("conv", F.col("d").alias("start"), F.col("name").alias("a")) if done else None
        rows = rows.join(known, ["conv", "start"], "left") if done else rows.withColumn("a", F.lit(None).cast("long"))
        rows = scratch.save(rows.select("conv", (F.col("start") + size).alias("d"), F.coalesce("a", F.lit(-1)).alias("a"), "b"), f"splits{k}")
        names, seen = dense_names(rows, ["d", "a", "b"], scratch, f"prefix_names{k}")
        done.append(scratch.save(join_counted(rows, names, ["d", "a", "b"], seen["total"], seen["most"]).select("conv", "d", "name", "rep"), f"prefixes{k}"))
        nodes.append(names.select("d", "rep", F.col("n_rows").alias("n_convs")))
    return (reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, nodes)) if done else (None, None)


def _chunks(batches):
    """Runs of sorted conversation numbers as text."""
    key, first, held, size = None, None, [], 0
    for batch in batches:
        out: list[dict] = []
        for d, rep, conv in zip(*(batch[c].to_pylist() for c in ("d", "rep", "conv"))):
            if (d, rep) != key or size > CHUNK:
                if held:
                    out.append({"d": key[0], "rep": key[1], "first": first, "part": ",".join(held)})
                key, first, held, size = (d, rep), conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        yield pa.RecordBatch.from_pylist(out, _PARTS)
    if held:
        yield pa.RecordBatch.from_pylist([{"d": key[0], "rep": key[1], "first": first, "part": ",".join(held)}], _PARTS)


_PARTS = pa.schema([("d", pa.int64()), ("rep", pa.int64()), ("first", pa.int64()), ("part", pa.string())])
_DIGESTS = pa.schema([("d", pa.int64()), ("rep", pa.int64()), ("ends_sha256", pa.string())])


def _digests(batches):
    """SHA-256 of each node's parts, which come in order."""
    key, state = None, None
    for batch in batches:
        out = []
        for d, rep, part in zip(*(batch[c].to_pylist() for c in ("d", "rep", "part"))):
            if (d, rep) == key:
                state.update(b",")
            else:
                if state:
                    out.append({"d": key[0], "rep": key[1], "ends_sha256": state.hexdigest()})
                key, state = (d, rep), hashlib.sha256()
            state.update(part.encode())
        yield pa.RecordBatch.from_pylist(out, _DIGESTS)
    if state:
        yield pa.RecordBatch.from_pylist([{"d": key[0], "rep": key[1], "ends_sha256": state.hexdigest()}], _DIGESTS)


def end_digests(ends: DataFrame) -> DataFrame:
    """(d, rep, ends_sha256). A digest reads its numbers one after the other, so they are packed into chunks by a range sort
    first, which splits large nodes, and one task then reads a node's chunks without holding them."""
    parts = ends.repartitionByRange("d", "rep", "conv").sortWithinPartitions("d", "rep", "conv").mapInArrow(_chunks, "d long, rep long, first long, part string")
    return parts.repartition("d", "rep").sortWithinPartitions("d", "rep", "first").mapInArrow(_digests, "d long, rep long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(turns.sparkSession, "trie")
    rows, convs, seen = rebuilt(turns, scratch)
    root, depth = F.lit(seen["first"]).cast("long"), seen["depth"] or 0
    known, nodes = prefixes(blocks(rows, depth, scratch), scratch)
    top = convs.agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(F.lit(0).cast("long").alias("d"), "rep", "n_convs", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("size"))
    ends = convs.where("n_rebuilt = 0").select(F.lit(0).cast("long").alias("d"), root.alias("rep"), "conv")
    if known is not None:
        above = lambda step, name: known.select(F.col("conv").alias("rep"), (F.col("d") + step).alias("d"), F.col("rep").alias(name))
        inner = nodes.join(above(1, "parent"), ["rep", "d"], "left").withColumn("parent", F.coalesce("parent", root))
        top = top.unionByName(inner.join(rows.select(F.col("conv").alias("rep"), (F.col("pos") + 1).alias("d"), "size"), ["rep", "d"]))
        ends = ends.unionByName(known.join(convs.select("conv", F.col("n_rebuilt").alias("d")), ["conv", "d"]).select("d", "rep", "conv"))
    tree = scratch.save(top, "tree")
    children = tree.where("d > 0").groupBy(F.col("parent").alias("rep"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"))
    now = tree.join(children, ["rep", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    now = scratch.save(now.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")}), "sums0")
    for k in range(depth.bit_length()):
        step = 1 << k
        lower = now.where(F.col("d") >= step).select("rep", "d", "n_leaves", "saved").join(above(step, "top"), ["rep", "d"], "left")
        more = lower.groupBy(F.coalesce("top", root).alias("rep"), (F.col("d") - step).alias("d")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        summed = {"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}
        now = scratch.save(now.join(more, ["rep", "d"], "left").withColumns(summed).drop("more_leaves", "more_saved"), f"sums{k + 1}")
    out = now.join(end_digests(ends), ["rep", "d"], "left")
    return out.select(F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


#: CRC-32 of a number's decimal form: 3988292384 is the reversed polynomial, 4294967295 the start and the final mask.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda acc, x: case when x >= 0 then xor(acc, x) else xor(acc >> 1, case when acc % 2 = 1 then 3988292384 else 0 end) end))"""

ORACLE_SQL = f"""
with own as (
  select conv_id c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 pos,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) t, strlen(coalesce(text, '')) size
  from conversations where conv_id is not null),
convs as (select c, count(*) n, {_CRC} % 9 h from own group by c),
heads as (
  select v.c, o.pos, o.t, o.size from convs v join own o on o.c = v.c - v.c % 5 where o.pos < v.h),
taken as (select c, count(*) n from heads group by c),
turns as (
  select * from heads union all
  select o.c, o.pos - v.h + coalesce(k.n, 0), o.t, o.size from own o join convs v on o.c = v.c left join taken k on k.c = v.c where o.pos >= v.h),
prefix as (
  select c, pos + 1 d, size, sha256(string_agg(t, '') over (partition by c order by pos rows between unbounded preceding and current row)) p from turns
  union all select c, 0, 0, '' from convs),
node as (select d, p, min(c) rep, count(*) n_convs, min(size) size from prefix group by d, p),
lengths as (select c, max(d) d from prefix group by c),
ends as (select d, p, sha256(string_agg(c::varchar, ',' order by c)) e from prefix join lengths using (c, d) group by d, p),
path as (select n.d, n.p, n.rep, q.d up, q.p pp from node n join prefix q on q.c = n.rep and q.d <= n.d),
parent as (select x.d, x.p, m.rep parent, m.p pp from path x join node m on m.d = x.up and m.p = x.pp where x.up = x.d - 1),
children as (select d - 1 d, pp p, count(*) k from parent group by d, pp),
value as (select n.d, n.p, (n.n_convs - 1) * n.size saved, coalesce(k, 0) k from node n left join children using (d, p)),
sums as (select x.up d, x.pp p, sum((v.k = 0)::int)::bigint n_leaves, sum(v.saved)::bigint saved_tokens from path x join value v on v.d = x.d and v.p = x.p group by x.up, x.pp)
select n.rep conv_id, n.d depth, parent.parent parent_conv_id, n.n_convs, v.k n_children, s.n_leaves, s.saved_tokens, coalesce(e.e, sha256('')) ends_sha256
from node n join value v using (d, p) join sums s using (d, p) left join parent using (d, p) left join ends e using (d, p)
"""
