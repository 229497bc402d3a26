"""Spelling, word breaks and suggestions from stored tables; nothing is compared with a whole dictionary at query time."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.analyzers import analyze_one, fold
from .index import BUCKETS, TermIndex, bucket_of

#: Letters of a word's start whose shortened forms are kept, and the greatest number of edits. Words within EDITS edits have
#: starts of this length which share what is left after EDITS deletions each, so no near word is missed.
START, EDITS = 8, 2
#: Letters of a half. A word of two halves or more is kept under forms of its first and its last letters instead: of two
#: edits one half has at most one, so one of the two has a form in common, and 10 forms do where the whole start has 37.
HALF = 4
#: Dictionaries by name: the index fields that they cover; none stands for all fields.
DICTIONARIES = {"default": None, "author": ["name_teim"], "subject": ["subject_teim"], "title": ["title_tesim", "normalized_title_teim"]}
#: Letters up to which every beginning of a word has its best values listed, and how many.
EDGE, BEST = 20, 5


def shortened(word: str) -> list[str]:
    """The start of a word without up to EDITS of its letters."""
    start = word[:START]
    keep = {start[:0]} if len(start) <= EDITS else set()
    for k in range(min(EDITS, len(start)) + 1):
        keep |= {"".join(c for i, c in enumerate(start) if i not in gone) for gone in combinations(range(len(start)), k)}
    return sorted(keep)


def _less(w: Column) -> Column:
    """The word without each of its letters."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.length(w)), lambda i: i > 0), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), w.substr(i + 1, F.length(w))))


def shortened_column(word: Column) -> Column:
    """shortened() as built-in expressions."""
    start = F.substring(word, F.lit(1), F.lit(START))
    one = _less(start)
    return F.array_distinct(F.concat(F.array(start), one, F.flatten(F.transform(one, _less))))


def asked_forms(word: str) -> list[str]:
    """All forms under which a near word can stand, short or long."""
    once = lambda w: {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
    return sorted({*shortened(word), *("^" + f for f in once(word[:HALF])), *("$" + f for f in once(word[-HALF:]))})


def kept_forms(word: Column) -> Column:
    """The forms under which a word is kept."""
    once = lambda w, mark: F.transform(F.array_distinct(F.concat(F.array(w), _less(w))), lambda f: F.concat(F.lit(mark), f))
    halves = F.concat(once(F.substring(word, 1, HALF), "^"), once(F.substring(word, -HALF, HALF), "$"))
    return F.when(F.length(word) < 2 * HALF, shortened_column(word)).otherwise(halves)


class Spelling:
    """Near words of an index. The table of shortened forms is written once for a state of the index, in hashed buckets."""

    def __init__(self, index: TermIndex, root: str):
        self.index, self.root = index, root.rstrip("/")

    def build(self) -> Spelling:
        """form -> word, for every word of the index."""
        words = self.index.dictionary().select(F.col("term").alias("word"))
        forms = words.select("word", F.explode(kept_forms(F.col("word"))).alias("form"))
        forms.withColumn("bucket", bucket_of(F.col("form"))).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "form").write.mode("overwrite").partitionBy("bucket").parquet(self.root)
        return self

    def near(self, word: str, dictionary: str = "default", count: int = 5, accuracy: float = 0.7, only_more_popular: bool = True) -> DataFrame:
        """(term, freq, accuracy): words within EDITS edits, best first; only_more_popular leaves out rarer ones than the word itself."""
        forms = asked_forms(word)
        rows = self.index.spark.read.parquet(self.root).where(F.col("bucket").isin(*(bucket_of(F.lit(f)) for f in forms)) & F.col("form").isin(*forms))
        edits = F.levenshtein("word", F.lit(word))
        close = 1 - edits / F.greatest(F.length("word"), F.lit(len(word)))
        found = rows.select("word").distinct().where((edits <= EDITS) & (close >= accuracy))
        counted = self.frequencies(found.select("word"), dictionary).select("word", "freq", close.alias("accuracy"))
        if only_more_popular:
            own = self.frequencies(self.index.spark.createDataFrame([(word,)], "word string"), dictionary).agg(F.coalesce(F.max("freq"), F.lit(0)).alias("own"))  # one row
            counted = counted.crossJoin(F.broadcast(own)).where("freq > own").drop("own")
        return counted.where(F.col("word") != word).select(F.col("word").alias("term"), "freq", F.round("accuracy", 6).alias("accuracy")).orderBy(F.desc("accuracy"), F.desc("freq"), "term").limit(count)

    def frequencies(self, words: DataFrame, dictionary: str = "default") -> DataFrame:
        """(word, freq) of given words in a dictionary."""
        fields = DICTIONARIES[dictionary]
        rows = self.index._rows("words", live=False)
        rows = rows.where(F.col("field").isin(*fields)) if fields else rows
        keys = words.select("word", bucket_of(F.col("word")).alias("bucket"))
        return rows.join(keys, ["bucket", "word"], "left_semi").groupBy("word").agg(F.sum("n").alias("freq")).where("freq > 0")

    def breaks(self, words: list[str], dictionary: str = "default") -> DataFrame:
        """(written, meant, freq): words that are two words of the dictionary, and neighbours that are one; freq is the rarer part's."""
        split = [(w, w[:k], w[k:]) for w in words for k in range(1, len(w))]
        joined = [(f"{a} {b}", a + b, None) for a, b in zip(words, words[1:])]
        tries = self.index.spark.createDataFrame(split + joined, "written string, a string, b string")
        known = self.frequencies(tries.select(F.explode(F.array_compact(F.array("a", "b"))).alias("word")).distinct(), dictionary)
        known = F.broadcast(known)  # at most two rows for each letter of the query
        out = tries.join(known.select(F.col("word").alias("a"), F.col("freq").alias("n")), "a").join(known.select(F.col("word").alias("b"), F.col("freq").alias("m")), "b", "left")
        return out.where("b is null or m is not null").select("written", F.concat_ws(" ", "a", "b").alias("meant"), F.least("n", "m").alias("freq")).orderBy(F.desc("freq"), "written", "meant")


class Suggestions:
    """Values by the beginnings of their words: the best of each short beginning are listed, so that a request reads one list."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, values: DataFrame, column: str) -> Suggestions:
        """values: one row for each use of a value; a value's weight is the number of its uses."""
        weighed = values.select(F.col(column).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("weight"))
        words = weighed.select("value", "weight", F.explode(F.array_distinct(analyze_one(F.col("value")))).alias("word"))
        self._write(words.withColumn("key", F.col("word")), "words")
        self._write(words.where(F.length("word") > EDGE).withColumn("key", F.substring("word", 1, EDGE)), "long")
        edges = words.select("value", "weight", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(EDGE))), lambda n: F.substring("word", F.lit(1), n))).alias("key")).distinct()
        # The first rows of each beginning are taken before the shuffle too, so a common one does not gather its values.
        place = F.row_number().over(Window.partitionBy("key").orderBy(*self._order()))
        self._write(edges.withColumn("place", place).where(F.col("place") <= BEST).drop("place"), "best")
        return self

    @staticmethod
    def _order() -> list[Column]:
        return [F.desc("weight"), F.length("value"), F.col("value")]

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.withColumn("bucket", bucket_of(F.col("key"))).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}")

    def _read(self, name: str, keys: list[str]) -> DataFrame:
        rows = self.spark.read.schema("value string, weight long, word string, key string, bucket int").parquet(f"{self.root}/{name}")
        return rows.where(F.col("bucket").isin(*(bucket_of(F.lit(k)) for k in keys)) & F.col("key").isin(*keys))

    def suggest(self, typed: str, count: int = BEST) -> DataFrame:
        """(value, weight): the heaviest values that hold all words typed, the last one as a beginning."""
        *whole, last = fold(typed).split() or [""]
        starts = F.exists(analyze_one(F.col("value")), lambda w: w.startswith(last))
        if whole:
            rows = self._read("words", whole).groupBy("value", "weight").agg(F.countDistinct("key").alias("n")).where((F.col("n") == len(set(whole))) & starts)
        elif len(last) > EDGE:
            rows = self._read("long", [last[:EDGE]]).where(starts).select("value", "weight").distinct()
        elif count > BEST:
            raise ValueError(f"lists hold {BEST} values")
        else:
            rows = self._read("best", [last])
        return rows.select("value", "weight").orderBy(*self._order()).limit(count)
