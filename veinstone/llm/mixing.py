"""Mixing sources to target weights by iterative proportional fitting.

Token counts are added up by cell (source, language, topic). Each round scales the cells' weights to the target
shares of one margin after the other until all three fit. A document's expected copies are its cell's fitted share of
the token budget over the cell's tokens. A hash of its id decides on the fraction, so the sample is repeatable; a cell
that has fewer tokens than its share gives each document the whole copies as well, so that the sample meets the targets
and the budget. The rate is the probability of one copy at least.

Only the table of cells is iterated on, and it is written between rounds; documents are read once to add up and
once to sample. The cells' table is kept in as few parts as its size needs. Nothing is collected but each round's
largest deviation, which is measured while the round is written; rows carry the last one as _deviation, the largest
relative change that a factor of that round made: 0 where all margins fit, more where targets contradict each other.

Defined cases: null sources and languages form cells of their own, written as an empty string; a null text has no
tokens, the empty topic and one copy, and so has an empty one; a very long text is counted whole; a value that given
targets do not name, or name with 0, gets weight 0, so its documents go; rows with equal ids share their decision; a null
id hashes as an empty string; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

MARGINS = ("source", "lang", "topic")
#: Targets flatten the observed shares by this power; budget is the share of all tokens to keep.
ALPHA, BUDGET, ROUNDS, TOLERANCE, SEED = 0.7, 0.9, 12, 1e-9, 7


def topic_of(text: Column) -> Column:
    """A coarse topic from layout and vocabulary."""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "")
        .when(text.rlike("(?i)licen[cs]e|copyright"), "legal")
        .when(text.rlike(r"\|[^|]*\|[^|]*\|"), "table")
        .when(text.rlike("https?://|www[.]"), "web")
        .when(text.rlike("[0-9]{3}"), "records")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """Runs of characters other than space and control white space."""
    plain = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(plain, " \t\n\u000b\f\r", "")), F.lit(0)).cast("long")


def cells_of(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens): partial sums on the map side, so a hot cell is one row for each task."""
    return docs.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")


def total_of(cells: DataFrame) -> Column:
    """All cells' tokens, as a scalar subquery."""
    return cells.agg(F.sum("tokens").cast("double").alias("all")).scalar()


def targets_of(cells: DataFrame, margin: str, alpha: float = ALPHA) -> DataFrame:
    """The margin's target shares: observed shares to the power alpha, made to add up to 1."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).withColumn("p", F.pow("t", F.lit(alpha)))
    return sums.select(margin, (F.col("p") / sums.agg(F.sum("p").alias("all")).scalar()).alias("target"))


#: Cells in one part of their table.
PART_CELLS = 50_000


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """The cells with fitted weights that add up to 1, and the largest deviation in the last round."""
    goals = {margin: f"target_{margin}" for margin in targets}
    now = cells.select(*MARGINS, "tokens", (F.col("tokens") / total_of(cells)).alias("weight"))
    # Each cell carries its targets, so that a margin takes one aggregation and one join.
    for margin, target in targets.items():
        now = now.join(target.withColumnRenamed("target", goals[margin]), margin, "left")
    # A table of a few hundred cells is one part, whatever the number of shuffle partitions is.
    now, found = scratch.save_measured(now, "start", F.count(F.lit(1)).alias("n"))
    parts, off = -(-max(1, found["n"]) // PART_CELLS), 0.0
    now = now.coalesce(parts)
    for k in range(rounds):
        now = now.withColumn("off", F.lit(0.0))
        for margin, goal in goals.items():
            now = now.join(now.groupBy(margin).agg(F.sum("weight").alias("sum")).coalesce(parts), margin)
            factor = F.coalesce(F.try_divide(goal, "sum"), F.lit(0.0))
            # A cell that no target names stays at weight 0 and says nothing about the fit.
            change = F.when(F.col("weight") > 0, F.abs(factor - 1)).otherwise(0.0)
            now = now.select(*MARGINS, "tokens", *goals.values(), (F.col("weight") * factor).alias("weight"), F.greatest("off", change).alias("off"))
        now, found = scratch.save_measured(now, f"round{k}", F.max("off").alias("off"))
        scratch.drop(f"round{k - 1}" if k else "start")
        # The largest change that any factor of this round made; none left means that all margins fit.
        off = found["off"] or 0.0
        if off <= tolerance:
            break
        now = now.drop("off").coalesce(parts)
    return now, off


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, alpha: float = ALPHA, rounds: int = ROUNDS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None,
) -> DataFrame:
    """The input rows with their topic, tokens, expected copies, probability, decision, copies and the fit's deviation.

    targets: margin -> (value, target) tables. topic: the topics of another model or of a column; topic_of() otherwise.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    added = {"_source": F.coalesce(F.col("source"), F.lit("")), "_lang": F.coalesce(F.col("lang"), F.lit("")), "_topic": F.coalesce(topic if topic is not None else topic_of(F.col(text_col)), F.lit("")), "_tokens": tokens_of(F.col(text_col))}
    marked = docs.withColumns(added)
    cells = scratch.save(cells_of(marked.select(*(F.col(f"_{m}").alias(m) for m in MARGINS), F.col("_tokens").alias("tokens"))), "cells")
    goals = targets or {m: targets_of(cells, m, alpha) for m in MARGINS}
    fitted, off = rake(cells, {m: scratch.save(t, f"target_{m}") for m, t in goals.items()}, scratch, rounds)
    rates = fitted.select(*(F.col(m).alias(f"_{m}") for m in MARGINS), (F.lit(budget) * F.col("weight") * total_of(cells) / F.col("tokens")).alias("_expected"))
    # The cells are far fewer than the documents; Spark broadcasts them only below its size threshold.
    out = marked.join(rates, [f"_{m}" for m in MARGINS], "left").withColumn("_expected", F.coalesce("_expected", F.lit(1.0)))
    out = out.withColumn("_rate", F.least(F.lit(1.0), "_expected"))
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    whole = F.floor("_expected")
    return out.withColumns({"_keep": draw < F.col("_rate"), "_copies": (whole + (draw < F.col("_expected") - whole).cast("int")).cast("int"), "_deviation": F.lit(off)})


def sample_mixture(docs: DataFrame, **how) -> DataFrame:
    """The rows that the mixture keeps, with all their columns, each as often as it has copies."""
    kept = mix(docs, **how).where("_keep")
    return kept.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.col("_copies")))).select(*docs.columns)


def oracle_sql(budget: float = BUDGET, alpha: float = ALPHA, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same mixture as DuckDB SQL over the documents table."""
    steps, prev = [], "r0"
    for k in range(rounds):
        for m in MARGINS:
            name = f"r{k + 1}_{m}"
            steps.append(f"{name} as materialized (select c.source, c.lang, c.topic, c.tokens, c.weight * t.target / s.w weight from {prev} c join (select {m}, sum(weight) w from {prev} group by 1) s on c.{m} = s.{m} join t_{m} t on t.{m} = c.{m})")
            prev = name
    targets = ", ".join(f"t_{m} as materialized (select {m}, p / sum(p) over () target from (select {m}, pow(sum(tokens)::double, {alpha}) p from cells group by 1))" for m in MARGINS)
    return f"""
with d as (select doc_id, coalesce(source, '') source, coalesce(lang, '') lang,
  case when coalesce(text, '') = '' then '' when regexp_matches(text, '(?i)licen[cs]e|copyright') then 'legal' when regexp_matches(text, '\\|[^|]*\\|[^|]*\\|') then 'table'
    when regexp_matches(text, 'https?://|www[.]') then 'web' when regexp_matches(text, '[0-9]{{3}}') then 'records' else 'prose' end topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint tokens from documents),
cells as materialized (select source, lang, topic, sum(tokens)::bigint tokens from d group by all having sum(tokens) > 0),
{targets},
r0 as materialized (select source, lang, topic, tokens, tokens / (select sum(tokens)::double from cells) weight from cells),
{", ".join(steps)},
rates as (select source, lang, topic, {budget} * weight * (select sum(tokens)::double from cells) / tokens expected from {prev}),
m as (select d.*, coalesce(expected, 1.0) expected, cast('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{seed}'), 1, 8) as bigint) / 4294967296.0 draw
  from d left join rates r on d.source = r.source and d.lang = r.lang and d.topic = r.topic)
select doc_id, source, lang, topic, tokens, round(expected, 6) expected, round(least(1.0, expected), 6) probability, draw < least(1.0, expected) keep,
  (floor(expected) + case when draw < expected - floor(expected) then 1 else 0 end)::int copies from m"""
