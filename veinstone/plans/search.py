"""Ranked search over a postings table, spelling, suggestions and highlights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.analyzers import analyze_one
from .request import SLOP, TIE, SearchRequest, least_terms

K1, B = 1.2, 0.75


def postings(docs: DataFrame, fields: dict[str, str], id_col: str = "id") -> DataFrame:
    """(field, term, id, tf, positions, len): one row for each term of a document's field.

    fields: index field -> text column. The grouping key holds the document, so no common term gathers anywhere.
    """
    each = [docs.select(F.col(id_col).alias("id"), F.lit(f).alias("field"), analyze_one(F.coalesce(F.col(c), F.lit(""))).alias("words")) for f, c in fields.items()]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("id", "field", F.size("words").alias("len"), F.posexplode("words").alias("pos", "term"))
    return rows.groupBy("field", "term", "id", "len").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def rank(index: DataFrame, terms: list[str], request: SearchRequest, n_docs: DataFrame | None = None) -> DataFrame:
    """(id, score, n_terms): the sum over terms of the best field's boosted BM25 plus TIE of the others, of documents
    with enough terms, plus phrase boosts. Filters on field and term reach the scan of the postings."""
    terms = list(dict.fromkeys(terms))
    hits = index.where(F.col("term").isin(*terms) & F.col("field").isin(*request.qf))
    sizes = index.groupBy("field").agg(F.countDistinct("id").alias("n"), (F.sum("tf") / F.countDistinct("id")).alias("mean_len"))
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    stats = df.join(sizes, "field").select("field", "term", "mean_len", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    boost = F.create_map(*[F.lit(x) for f, b in request.qf.items() for x in (f, float(b))])[F.col("field")]
    # One row for each field and query term: a few dozen, however large the corpus is.
    scored = hits.join(F.broadcast(stats), ["field", "term"]).withColumn("w", boost * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len"))))
    by_term = scored.groupBy("id", "term").agg((F.max("w") + TIE * (F.sum("w") - F.max("w"))).alias("w"))
    out = by_term.groupBy("id").agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("n_terms")).where(F.col("n_terms") >= least_terms(len(terms), request.mm))
    if len(terms) < 2:
        return out
    phrase = phrase_matches(hits, terms, request)
    return out.join(phrase, "id", "left").select("id", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"), "n_terms")


def phrase_matches(hits: DataFrame, terms: list[str], request: SearchRequest, slop: int = SLOP) -> DataFrame:
    """(id, boost): the best phrase boost among fields in which all terms stand near each other, in order."""
    near = hits.groupBy("id", "field").agg(F.count(F.lit(1)).alias("n"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at")).where(F.col("n") == len(terms))

    def follows(k: int, first: Column) -> Column:
        return F.exists(F.col("at")[terms[k]], lambda x: F.abs(x - first - k) <= slop)

    together = F.exists(F.col("at")[terms[0]], lambda p: reduce(lambda a, b: a & b, [follows(k, p) for k in range(1, len(terms))]))
    boost = F.create_map(*[F.lit(x) for f, b in request.pf.items() for x in (f, float(b))])[F.col("field")]
    return near.where(together).groupBy("id").agg(F.max(boost).alias("boost"))


def enough_terms(docs: DataFrame, terms: list[str], mm: str, text: str) -> DataFrame:
    """Documents that hold enough of the terms, without a score."""
    words = analyze_one(F.col(text))
    found = F.size(F.array_intersect(words, F.array(*map(F.lit, dict.fromkeys(terms)))))
    return docs.withColumn("n_terms", found).where(found >= least_terms(len(set(terms)), mm))


def spelling(dictionary: DataFrame, word: str, count: int = 5, accuracy: float = 0.7) -> DataFrame:
    """(term, freq): near and more frequent terms of a (term, freq) dictionary, best first."""
    near = 1 - F.levenshtein("term", F.lit(word)) / F.greatest(F.length("term"), F.lit(len(word)))
    own = dictionary.where(F.col("term") == word).agg(F.coalesce(F.max("freq"), F.lit(0)).alias("own"))  # one row
    return dictionary.crossJoin(F.broadcast(own)).where((F.col("term") != word) & (near >= accuracy) & (F.col("freq") > F.col("own"))).select("term", "freq", F.round(near, 6).alias("accuracy")).orderBy(F.desc("accuracy"), F.desc("freq"), "term").limit(count)


def suggest(values: DataFrame, column: str, typed: str, count: int = 5) -> DataFrame:
    """Values that contain what was typed, shortest first."""
    return values.select(F.col(column).alias("value")).where(F.lower("value").contains(typed.lower())).distinct().orderBy(F.length("value"), "value").limit(count)


def highlight(c: Column, terms: list[str], around: int = 40) -> Column:
    """The first place of a term with some text around it, marked; null where there is none."""
    import re

    word = "|".join(re.escape(t) for t in terms)
    part = F.regexp_extract(c, rf"(?is)(.{{0,{around}}}\b(?:{word})\b.{{0,{around}}})", 1)
    return F.when(part != "", F.regexp_replace(part, rf"(?i)\b({word})\b", "<em>$1</em>"))


def did_you_mean(hits: DataFrame, most: int = 5) -> bool:
    """Spelling is offered for few hits only; a bounded probe."""
    return hits.limit(most + 1).count() <= most


def best_first(ranked: DataFrame, docs: DataFrame, rows: int = 10) -> DataFrame:
    """The first page by score, position and title."""
    top = ranked.join(docs, "id").orderBy(F.desc("score"), F.asc("sort_isi"), F.asc_nulls_last("title_sort"), "id")
    return top.limit(rows)


def grouped_hits(ranked: DataFrame, docs: DataFrame, key: str = "_root_", top: int = 3) -> DataFrame:
    """Groups by their best document, each with its first rows and total."""
    rows = ranked.join(docs, "id")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "sort_isi", "id"))
    totals = rows.groupBy(key).agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("group_total"))
    return rows.withColumn("place", place).where(F.col("place") <= top).join(totals, key).orderBy(F.desc("best"), key, "place")
