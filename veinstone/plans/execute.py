"""One search path: a request's rewrites, text, filters, facets, groups, order, page and highlights over a table of documents.

What the text parts need comes from a source: a stored index (index.TermIndex), whose buckets of the query's terms alone are
read, or one narrow pass over the text columns (Scan). Statistics are those of all documents, whatever the filters are.
Queries with operators, quotes, parentheses or wildcards are filtered by their tree and ranked by its positive leaves;
others need enough of their words. Without words every document matches with a constant score.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.analyzers import fold, query_terms, stem, stem_forms
from ..operators import relational as R
from ..operators.shared import new_folder
from .fragments import fragments
from .index import TermIndex, pattern_regex, placed_words
from .request import SLOP, TIE, SearchRequest, has_syntax, holds, least_terms, leaves, parse, rewrite
from .search import B, K1

#: Filters by the request's names: document field. Values that stand for another one: fixed values.
FILTERS = {"collection": "collection_ssim", "level": "level_ssm", "access": "has_online_content_ssim", "repository": "repository_ssim", "creators": "creator_ssim", "names": "names_ssim", "places": "geogname_ssim", "access_subjects": "access_subjects_ssim"}
VALUES = {("access", "digital_content"): "true"}
RANGES = {"date_range": "date_range_isim"}
#: Orders by the request's names; rows without a value come last either way: fixed values.
SORTS = {f"{f} {d}": (f, d) for f in ("date_sort", "creator_sort", "title_sort") for d in ("asc", "desc")}


@dataclass
class Found:
    """hits: the page in order; total: one row; facets: (field, value, count, place); ranked: all matches with their scores."""

    hits: DataFrame
    total: DataFrame
    facets: DataFrame | None
    ranked: DataFrame


def within(r: SearchRequest, collection: str | None) -> SearchRequest:
    """Search inside one collection, or in all of them: the collection's filter is put in or taken out."""
    rest = {k: v for k, v in r.filters.items() if k != "collection"}
    return SearchRequest(**{**r.__dict__, "filters": rest | ({"collection": [collection]} if collection else {})})


def filters_of(r: SearchRequest, names: dict[str, str] = FILTERS) -> Column:
    """Values of one filter are alternatives, filters and ranges add up; a name with a leading minus excludes.

    A range has a begin, an end or both; the range "missing" keeps rows without any value."""
    clauses = []
    for name, values in r.filters.items():
        plain = name.lstrip("-")
        field = names.get(plain, plain)
        some = [R.has(field, VALUES.get((plain, v), v)) for v in values]
        if some:
            any_of = reduce(lambda a, b: a | b, some)
            clauses.append(~F.coalesce(any_of, F.lit(False)) if name.startswith("-") else any_of)
    for name, span in r.range.items():
        field = RANGES.get(name, name)
        if span == "missing":
            clauses.append(F.coalesce(F.size(field) <= 0, F.lit(True)))
        else:
            clauses.append(_some_year(field, span.get("begin"), span.get("end")))
    return R.all_of(*clauses)


def _some_year(field: str, low, high) -> Column:
    ends = [(">=", low), ("<=", high)]
    return F.exists(field, lambda y: R.all_of(y.isNotNull(), *(y >= int(v) if way == ">=" else y <= int(v) for way, v in ends if v not in (None, ""))))


class Scan:
    """Hits and statistics from the documents' own text: one pass without a shuffle, whose narrow rows are stored, for
    scores read them several times."""

    def __init__(self, docs: DataFrame, id_col: str = "id"):
        self.docs, self.id_col = docs, id_col
        self.sized: tuple[list[str], DataFrame] | None = None

    def _placed(self, fields: list[str]) -> DataFrame:
        return self.docs.select(F.col(self.id_col).alias("id"), *(placed_words(self.docs, f).alias(f"_w_{f}") for f in fields))

    def hits(self, terms: list[str], patterns: list[str], fields: list[str]) -> DataFrame:
        """(id, field, len, term, at): the places of each stem, and of each pattern under its own text, in each field."""
        def hit(field: str, label: str, fits) -> Column:
            at = F.transform(F.filter(f"_w_{field}", lambda x: fits(x["word"])), lambda x: x["at"])
            return F.struct(F.lit(field).alias("field"), F.size(f"_w_{field}").alias("len"), F.lit(label).alias("term"), at.alias("at"))

        made = [hit(f, t, lambda w, t=t: w.isin(*stem_forms(t))) for f in fields for t in terms]
        made += [hit(f, p, lambda w, p=p: w.rlike(pattern_regex(p))) for f in fields for p in patterns]
        if not made:
            return self._placed(fields).where("false").selectExpr("id", "'' as field", "0 as len", "'' as term", "array(0) as at")
        sizes = F.array(*(F.size(f"_w_{f}") for f in fields))
        at = new_folder(self.docs.sparkSession, "scan")
        self._placed(fields).select("id", sizes.alias("sizes"), F.filter(F.array(*made), lambda h: F.size(h["at"]) > 0).alias("hits")).write.parquet(at)
        rows = self.docs.sparkSession.read.parquet(at)
        self.sized = fields, rows.select(*(F.col("sizes")[k].alias(f"_n_{f}") for k, f in enumerate(fields)))
        return rows.select("id", F.explode("hits").alias("h")).select("id", "h.*")

    def sizes(self, fields: list[str]) -> DataFrame:
        """(field, n, mean): the documents that have words in a field and their mean number."""
        out = []
        for f in fields:
            n = F.col(f"_n_{f}")
            out += [F.count_if(n > 0).alias(f"n_{f}"), F.try_divide(F.sum(n), F.count_if(n > 0)).alias(f"mean_{f}")]
        one = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("n"), F.col(f"mean_{f}").alias("mean")) for f in fields))
        sized = self.sized[1] if self.sized and self.sized[0] == fields else self._placed(fields).select(*(F.size(f"_w_{f}").alias(f"_n_{f}") for f in fields))
        return sized.agg(*out).select(F.explode(one).alias("s")).select("s.*")


def _together(hits: DataFrame, terms: list[str], apart: int) -> DataFrame:
    """(id, field) where the terms stand in order, each within `apart` places of where a phrase has it."""
    near = hits.where(F.col("term").isin(*terms)).groupBy("id", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("at")).where(F.size("at") == len(set(terms)))
    follows = lambda k, first: F.exists(F.col("at")[terms[k]], lambda x: F.abs(x - first - k) <= apart)
    return near.where(F.exists(F.col("at")[terms[0]], lambda p: reduce(lambda a, b: a & b, [follows(k, p) for k in range(1, len(terms))], F.lit(True)))).select("id", "field")


def score(hits: DataFrame, sizes: DataFrame, terms: list[str], r: SearchRequest, least: int) -> DataFrame:
    """(id, score, n_terms): for each term the best field's boosted BM25 and TIE of the others', added up over terms,
    and the best field's phrase boost where all terms stand within SLOP places; documents with enough terms."""
    hits = hits.where(F.col("term").isin(*terms))
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    # One row of statistics for each field, and one for each field and term of the query: small whatever the corpus.
    stats = df.join(F.broadcast(sizes), "field").select("field", "term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    boost = F.create_map(*[F.lit(x) for f, b in r.qf.items() for x in (f, float(b))])[F.col("field")]
    tf = F.size("at")
    w = boost * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = hits.join(F.broadcast(stats), ["field", "term"]).withColumn("w", w)
    by_term = scored.groupBy("id", "term").agg((F.max("w") + TIE * (F.sum("w") - F.max("w"))).alias("w"))
    out = by_term.groupBy("id").agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("n_terms")).where(F.col("n_terms") >= least)
    phrased = {f: b for f, b in r.pf.items() if b}
    if len(terms) < 2 or not phrased:
        return out
    weight = F.create_map(*[F.lit(x) for f, b in phrased.items() for x in (f, float(b))])[F.col("field")]
    phrase = _together(hits.where(F.col("field").isin(*phrased)), terms, SLOP).groupBy("id").agg(F.max(weight).alias("boost"))
    return out.join(phrase, "id", "left").select("id", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"), "n_terms")


def dismax(docs: DataFrame, r: SearchRequest, id_col: str = "id", index: TermIndex | None = None) -> DataFrame:
    """(id, score, n_terms) of a request's plain words over all documents."""
    terms = list(dict.fromkeys(stem(fold(t)) for t in query_terms(r.q)))
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("n_terms"))
    fields = [f for f in r.qf if f in docs.columns]
    source = index or Scan(docs, id_col)
    return score(source.hits(terms, [], fields), source.sizes(fields), terms, r, least_terms(len(terms), r.mm))


def _as_id(rows: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """The index's ids are text; the documents' have a type of their own."""
    return rows.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def by_tree(docs: DataFrame, rows: DataFrame, tree, r: SearchRequest, id_col: str, index: TermIndex | None) -> DataFrame:
    """(id, score, n_terms) of the rows for which a boolean query holds, ranked by its leaves that are not denied."""
    fields = [f for f in r.qf if f in docs.columns]
    source = index or Scan(docs, id_col)
    every = leaves(tree)
    words = sorted({w for kind, body, _ in every for w in ([body] if kind == "term" else body if kind == "phrase" else [])})
    patterns = sorted({body for kind, body, _ in every if kind == "pattern"})
    hits = _as_id(source.hits(words, patterns, fields), docs, id_col)
    marks = hits.select("id", "term")
    for kind, body, _ in every:
        if kind == "phrase":
            marks = marks.unionByName(_together(hits, body, 0).select("id", F.lit(" ".join(['"', *body])).alias("term")))
    labels = marks.groupBy("id").agg(F.collect_set("term").alias("labels"))
    told = F.coalesce("labels", F.array().cast("array<string>"))
    test = holds(tree, lambda label: F.array_contains(told, label), lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)
    without = holds(tree, lambda label: False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)
    kept = rows.select(F.col(id_col).alias("id")).join(labels, "id", "left" if without else "inner").where(test).select("id")
    positive = list(dict.fromkeys(w for kind, body, denied in every if not denied for w in ([body] if kind != "phrase" else body)))
    if not positive:
        return kept.select("id", F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("n_terms"))
    found = score(hits, source.sizes(fields), positive, r, 0)
    return kept.join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"))


def search(docs: DataFrame, request: SearchRequest, facets: list[str] | None = None, marked: str | None = None, id_col: str = "id", names: dict[str, str] = FILTERS, index: TermIndex | None = None) -> Found:
    """Runs a request: text and filters choose rows, scores or a named field order them, and a page comes out.

    Grouped requests give the first rows of each block with the group's total; a page of a group is a page of blocks.
    """
    r = rewrite(request)
    rows = docs.where(filters_of(r, names))
    tree = parse(r.q) if has_syntax(r.q) else None
    if tree:
        ranked = by_tree(docs, rows, tree, r, id_col, index)
    elif query_terms(r.q):
        ranked = _as_id(dismax(docs, r, id_col, index), docs, id_col).join(rows.select(F.col(id_col).alias("id")), "id", "left_semi")
    else:
        ranked = dismax(rows, r, id_col)
    found = rows.join(ranked.withColumnRenamed("id", id_col), id_col)
    if r.sort in SORTS and SORTS[r.sort][0] in docs.columns:
        field, way = SORTS[r.sort]
        order = [F.asc_nulls_last(field) if way == "asc" else F.desc_nulls_last(field), F.asc(id_col)]
        best = (F.min if way == "asc" else F.max)(field).alias("best")
        by_best = [F.asc_nulls_last("best") if way == "asc" else F.desc_nulls_last("best"), F.asc("_root_")]
    else:
        last = R.collection_last() if "collection_last" in (r.order, r.group_order) else F.desc("score")
        order = [last, *(c for c in (F.asc("sort_isi"),) if "sort_isi" in docs.columns), *(c for c in (F.asc_nulls_last("title_sort"),) if "title_sort" in docs.columns), F.asc(id_col)]
        best, by_best = F.max("score").alias("best"), [F.desc("best"), F.asc("_root_")]
    start = (max(1, r.page) - 1) * r.per_page
    if r.group == "true" and "_root_" in docs.columns:
        top = found.groupBy("_root_").agg(best).orderBy(*by_best).offset(start).limit(r.per_page)
        hits = R.group_top(found.join(top.select("_root_"), "_root_", "left_semi"), "_root_", *order).join(top, "_root_").orderBy(*by_best, "place")
    else:
        hits = R.page(found, *order, start=start, rows=r.per_page)
    if marked:
        words = [w for kind, body, denied in leaves(tree) if not denied and kind != "pattern" for w in ([body] if kind == "term" else body)] if tree else [fold(t) for t in query_terms(r.q)]
        values = F.col(marked) if docs.schema[marked].dataType.typeName() == "array" else F.array(marked)
        hits = hits.withColumn("highlight", F.get(fragments(values, words), 0) if words else F.lit(None).cast("string"))
    return Found(hits, found.agg(F.count(F.lit(1)).alias("hits")), R.facet_page(found, facets) if facets else None, ranked)


def resolve(docs: DataFrame, ark: Column, field: str = "ark_id_ssi", id_col: str = "id") -> DataFrame:
    """The smallest id with the persistent identifier, hyphenated or not; no row where none has it."""
    from ..functions.text import hyphenate_ark

    return docs.where(F.col(field) == hyphenate_ark(ark)).orderBy(id_col).limit(1).select(id_col)
