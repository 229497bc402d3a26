"""Fragments of a text in which a query's words stand, with all their forms marked."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.analyzers import fold_column, stem, stem_forms

#: Words of a fragment and fragments of a text.
SIZE, COUNT = 20, 1


def _cut(text: Column, terms: list[str], size: int) -> Column:
    """(score, hits, k, text) of each fragment: runs of `size` words, with what stands between and behind them."""
    forms = [f for t in dict.fromkeys(map(stem, terms)) for f in stem_forms(t)]
    numbers = F.create_map(*[F.lit(x) for k, t in enumerate(dict.fromkeys(map(stem, terms))) for f in stem_forms(t) for x in (f, k)])
    word = r"[\p{L}\p{N}\p{M}]+"

    def once(value: Column, body) -> Column:
        """The array that body makes of a value; the value is computed once, not at each place where body names it."""
        return F.flatten(F.transform(F.array(value), body))

    def marked(x: Column, gap: Column) -> Column:
        hit = x["f"].isin(*forms)
        return F.struct(F.concat(F.when(hit, F.concat(F.lit("<em>"), x["w"], F.lit("</em>"))).otherwise(x["w"]), gap).alias("t"), F.when(hit, numbers[x["f"]]).alias("m"))

    def fragment(parts: Column, lead: Column, k: Column) -> Column:
        return F.transform(F.array(F.slice(parts, k * size + 1, F.lit(size))), lambda own: F.struct(
            F.size(F.array_distinct(F.array_compact(own["m"]))).alias("score"), F.size(F.array_compact(own["m"])).alias("hits"), (-k).alias("k"),
            F.trim(F.concat(F.when(k == 0, lead).otherwise(""), F.array_join(own["t"], ""))).alias("text")))[0]

    def cut(b: Column) -> Column:
        gaps = b["gaps"]  # one more than there are words
        return once(F.zip_with(b["words"], F.slice(gaps, 2, F.size(gaps)), marked), lambda parts: F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / size).cast("int")), lambda k: fragment(parts, gaps[0], k))).otherwise(F.array()))

    words = F.transform(F.regexp_extract_all(text, F.lit(f"({word})"), 1), lambda w: F.struct(w.alias("w"), fold_column(w).alias("f")))
    return once(F.struct(words.alias("words"), F.split(text, word).alias("gaps")), cut)


def fragments(values: Column, terms: list[str], size: int = SIZE, count: int = COUNT) -> Column:
    """The fragments of an array of texts with the most different words of the query, then the most hits, then the first;
    none without a hit. Fragments do not cross from one text to the next."""
    every = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: _cut(F.coalesce(v, F.lit("")), terms, size)))
    some = F.filter(every, lambda x: x["score"] > 0)
    return F.transform(F.slice(F.array_sort(some, lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).when(a["hits"] != b["hits"], b["hits"] - a["hits"]).otherwise(F.lit(0))), 1, count), lambda x: x["text"])
