"""URL filter: host rules, then the ratio of two character language models.

Urls that a rule accepts and urls that a rule rejects train one variable-order Markov model each (orders 0 to ORDER,
each smoothed with the next shorter one). A url that no rule fits is judged by its length-normalised log-likelihood
difference against a cut halfway between the mean differences of accepted and rejected urls that the models have not
seen: a quarter of the urls, told by their MD5, is held out of the training for this. Everything is DataFrame operations: characters become rows, counts and models are tables, and joins go by context and character,
so no part is held in one task.

Defined cases: a null url, or one without "://", has an empty host and path and no text to score, and is allowed,
as is every url when either class has no examples; a class without held-out urls is calibrated on all of its urls; an empty host fits no rule; repeated rows each get their own row
and count in training or calibration as often as they occur; equal scores get equal verdicts, and a score on the cut is allowed;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

#: (verdict, host, path); the longest host and path wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER, SMOOTH, ALPHABET = 3, 4.0, 256.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PAD = "\u0002" * ORDER
#: First MD5 digits of the urls that calibrate the cut instead of training the models.
HELD = "0123"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    """What follows the first "://"; null without one."""
    return F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: reduce(lambda c, x: c.when(x[0], F.lit(x[1])), zip(fits[1:], values[1:]), F.when(fits[0], F.lit(values[0])))
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def _log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio) from (ctx, ch, a, b): ln P(ch | ctx) under the accepted model less that under the rejected one."""
    level = {ORDER: counts}
    for k in range(ORDER - 1, -1, -1):
        up = level[k + 1]
        level[k] = up.groupBy((F.substring("ctx", 2, k) if k else F.lit("")).alias("ctx"), "ch").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    made = None
    for k in range(ORDER + 1):
        here = level[k]
        total = here.groupBy("ctx").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
        here = here.join(total, "ctx")
        if made is None:
            lower = here.withColumns({"qa": F.lit(1 / ALPHABET), "qb": F.lit(1 / ALPHABET)})
        else:
            short = made.select(F.col("ctx").alias("short"), "ch", F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            lower = here.withColumn("short", F.substring("ctx", 2, k - 1) if k > 1 else F.lit("")).join(short, ["short", "ch"])
        made = lower.select("ctx", "ch", ((F.col("a") + SMOOTH * F.col("qa")) / (F.col("ta") + SMOOTH)).alias("pa"), ((F.col("b") + SMOOTH * F.col("qb")) / (F.col("tb") + SMOOTH)).alias("pb"))
    return made.select(F.xxhash64("ctx", "ch").alias("gram"), (F.log("pa") - F.log("pb")).alias("ratio"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule and verdict."""
    url = F.col("url")
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.translate(_rest(url), _UPPER, _LOWER).alias("line"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})

    # Equal urls have equal rules, so each is scored once; accepted and rejected say how often it occurs as either, a and b
    # how often it trains either model.
    lines = rows.where("line is not null and line != ''").groupBy("line").agg(F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("rejected"))
    held = F.substring(F.md5("line"), 1, 1).isin(*HELD)
    lines = lines.withColumn("held", held).withColumns({"a": F.when(~F.col("held"), F.col("accepted")).otherwise(0), "b": F.when(~F.col("held"), F.col("rejected")).otherwise(0)})
    padded = F.concat(F.lit(_PAD), F.col("line"))
    grams = lines.select("line", "a", "b", F.posexplode(F.split("line", "")).alias("i", "ch")).where("ch != ''")
    ctx = padded.substr(F.col("i") + 1, F.lit(ORDER))
    counts = scratch.save(grams.groupBy(ctx.alias("ctx"), "ch").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "counts")
    ratios = scratch.save(_log_ratios(counts), "ratios")
    # A url's characters travel as two numbers each; its class counts come along once.
    name = [F.xxhash64("line").alias("key"), F.xxhash64(F.lit(1), "line", F.length("line")).alias("key2")]
    coded = grams.select(*name, F.xxhash64(ctx, F.col("ch")).alias("gram"))
    means = coded.join(ratios, "gram").groupBy("key", "key2").agg(F.avg("ratio").alias("score"))
    scores = scratch.save(means.join(lines.select("line", *name, "held", "accepted", "rejected"), ["key", "key2"]).drop("key", "key2"), "scores")
    mean = lambda times: F.try_divide(F.sum(F.col("score") * times), F.sum(times))
    unseen = lambda c: F.coalesce(mean(F.when(F.col("held"), F.col(c))), mean(F.col(c)))
    cut = scores.agg(((unseen("accepted") + unseen("rejected")) / 2).alias("cut")).scalar()  # null where either class has no examples
    judged = scores.select(F.col("line").alias("_line"), (F.col("score") < cut).alias("bad"))
    out = rows.join(judged, rows.line == judged["_line"], "left")  # by the url itself: no hash can double a row
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def oracle_sql(rules=RULES) -> str:
    """The same filter as DuckDB SQL over the pages table."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    case = lambda i: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{(h + p) if i else v}'" for v, h, p in ordered) + " end"
    lower = f"translate(%s, '{_UPPER}', '{_LOWER}')"
    parts, prev = [], None
    for k in range(ORDER, -1, -1):
        ctx = f"substr(ctx, 2, {k})" if k else "''"
        parts.append(f"c{k} as (select {'ctx' if k == ORDER else ctx} ctx, ch, sum(a)::double a, sum(b)::double b from {'grams' if k == ORDER else f'c{k + 1}'} group by 1, 2)")
    for k in range(ORDER + 1):
        tot = f"t{k} as (select ctx, sum(a) ta, sum(b) tb from c{k} group by 1)"
        if prev is None:
            m = f"m{k} as (select c.ctx, c.ch, (a + {SMOOTH} / {ALPHABET}) / (ta + {SMOOTH}) pa, (b + {SMOOTH} / {ALPHABET}) / (tb + {SMOOTH}) pb from c{k} c join t{k} t on c.ctx = t.ctx)"
        else:
            short = f"substr(c.ctx, 2, {k - 1})" if k > 1 else "''"
            m = f"m{k} as (select c.ctx, c.ch, (a + {SMOOTH} * q.pa) / (ta + {SMOOTH}) pa, (b + {SMOOTH} * q.pb) / (tb + {SMOOTH}) pb from c{k} c join t{k} t on c.ctx = t.ctx join {prev} q on q.ctx = {short} and q.ch = c.ch)"
        parts += [tot, m]
        prev = f"m{k}"
    return f"""
with r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end rest from pages),
h as (select page_id, coalesce({lower % "regexp_extract(rest, '^([^/?#]*)', 1)"}, '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path, {lower % 'rest'} line from r),
f as (select *, {case(1)} "rule", {case(0)} ruled from h),
urls as (select line, substr(md5(line), 1, 1) <= '{HELD[-1]}' held, count(*) filter (ruled = 'allow') accepted, count(*) filter (ruled = 'block') rejected from f where line != '' group by 1),
lines as (select line, case when held then 0 else accepted end a, case when held then 0 else rejected end b from urls),
pos as (select line, a, b, unnest(range(1, length(line) + 1)) i from lines),
grams as (select line, a, b, substr(repeat(chr(2), {ORDER}) || line, i, {ORDER}) ctx, substr(line, i, 1) ch from pos),
{", ".join(parts)},
s as (select line, avg(ln(pa) - ln(pb)) score from grams g join {prev} m on m.ctx = g.ctx and m.ch = g.ch group by 1),
means as (select sum(score * accepted) filter (held) / nullif(sum(accepted) filter (held), 0) ha, sum(score * rejected) filter (held) / nullif(sum(rejected) filter (held), 0) hr,
  sum(score * accepted) / nullif(sum(accepted), 0) a, sum(score * rejected) / nullif(sum(rejected), 0) r from s join urls using (line)),
cut as (select (coalesce(ha, a) + coalesce(hr, r)) / 2 cut from means)
select page_id, host, path, "rule", coalesce(ruled, case when score < cut then 'block' else 'allow' end) verdict
from f left join s on f.line = s.line cross join cut"""
