"""A stored inverted index: postings in hashed buckets, kept up to date by whole blocks.

An index is a folder of Parquet tables in segments. A build writes one segment; an update writes the postings of the changed
blocks as another one, with the list of blocks whose earlier postings no longer count. A manifest names the segments that
count and carries the statistics; it is written last, under a new number, so a reader sees the old state or the new one and
a failed update leaves nothing that counts. Searches read the buckets of their terms only, and no text.

docs: block, id, field, len, its words in order and their places (null: 0, 1, ...); written where the documents are read.
postings: bucket of the stem, term (stem), word, field, and of some documents with the word the ids, blocks (null: the ids),
lengths, places, and where each document's places end; n, how many they are. A task packs its documents, so that not each
posting is a row of the shuffle.
words: bucket of the word, word, stem, field, n documents (negative in an update for blocks that it replaces).
grams: bucket of a three-letter part, gram, word, stem, for wildcards; an index without them scans the words instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.analyzers import GAP, analyze_one, stem_column

BUCKETS = 64
#: Words that a task packs at once.
PACKED = 1 << 22


def bucket_of(value: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def placed_words(docs: DataFrame, field: str) -> Column:
    """Array of (at, word) of a field; values of a list stand GAP places apart, so that no phrase spans two of them."""
    if docs.schema[field].dataType.typeName() != "array":
        return F.transform(analyze_one(F.coalesce(F.col(field).cast("string"), F.lit(""))), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    each = F.transform(F.coalesce(F.col(field), F.array().cast("array<string>")), analyze_one)
    # The first place of each value: behind all earlier words, and GAP for each earlier value.
    starts = F.aggregate(each, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(v) + GAP)))
    return F.flatten(F.zip_with(each, F.slice(starts, F.lit(1), F.size(each)), lambda v, s: F.transform(v, lambda w, i: F.struct((s + i).alias("at"), w.alias("word")))))


def forward(docs: DataFrame, fields: list[str], id_col: str, block_col: str) -> DataFrame:
    """(id, block, field, len, words, at): one row for each field that has words."""
    def words(f: str) -> Column:
        if docs.schema[f].dataType.typeName() != "array":
            return F.struct(F.lit(f).alias("field"), analyze_one(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("words"), F.lit(None).cast("array<int>").alias("at"))
        placed = placed_words(docs, f)
        return F.struct(F.lit(f).alias("field"), F.transform(placed, lambda x: x["word"]).alias("words"), F.transform(placed, lambda x: x["at"]).alias("at"))

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(block_col).cast("string").alias("block"), F.explode(F.array(*map(words, fields))).alias("e"))
    return rows.select("id", "block", "e.*").where(F.size("words") > 0).select("id", "block", "field", F.size("words").alias("len"), "words", "at")


_PACKS = "word string, field string, n int, ids array<string>, blocks array<string>, lens array<int>, ends array<int>, places array<int>"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each word and field of a batch, from rows (id, block, field, len, words, at)."""
    for whole in batches:
        cut = np.cumsum(whole["len"].to_numpy()) // PACKED
        ends = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), whole.num_rows]
        for batch in (whole.slice(a, b - a) for a, b in zip(ends, ends[1:])):
            if batch.num_rows:
                yield _pack(batch)


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    size = batch["len"].to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    given = np.repeat(np.asarray(batch["at"].is_valid()), size)
    at[given] = pc.list_flatten(batch["at"]).to_numpy(zero_copy_only=False)
    words, fields = pc.list_flatten(batch["words"]).dictionary_encode(), batch["field"].dictionary_encode()
    kinds = len(fields.dictionary)
    key = words.indices.to_numpy().astype(np.int64) * kinds + fields.indices.to_numpy()[row]
    order = np.argsort(key, kind="stable")  # rows and places stay in order
    key, row, at = key[order], row[order], at[order]
    new_key = np.r_[True, key[1:] != key[:-1]]
    first = np.flatnonzero(new_key | np.r_[True, row[1:] != row[:-1]])  # of each posting
    start = np.flatnonzero(new_key[first])  # of each row, in postings
    bounds = np.r_[start, len(first)]
    begin = first[start]
    own = np.r_[first[1:], len(key)] - np.repeat(begin, np.diff(bounds))
    offsets = pa.array(bounds.astype(np.int32))
    docs = pa.array(row[first])
    ids = batch["id"].take(docs)
    same = pc.all(pc.fill_null(pc.equal(batch["id"], batch["block"]), False)).as_py()
    blocks = pa.nulls(len(start), pa.list_(pa.string())) if same else pa.ListArray.from_arrays(offsets, batch["block"].take(docs))
    places = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(key)].astype(np.int32)), pa.array(at.astype(np.int32)))
    numbers = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (size[row[first]], own)]
    named = [words.dictionary.take(pa.array(key[begin] // kinds)), fields.dictionary.take(pa.array(key[begin] % kinds))]
    return pa.RecordBatch.from_arrays([*named, pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(offsets, ids), blocks, *numbers, places], names=[c.split()[0] for c in _PACKS.split(", ")])


def _unpacked(packs: DataFrame) -> DataFrame:
    """(segment, term, word, field, id, block, len, at) of each document in packed rows."""
    def one(i: Column, k: Column) -> Column:
        start = F.when(k > 0, F.get("ends", k - 1)).otherwise(0)
        block = F.coalesce(F.get("blocks", k), F.when(F.col("blocks").isNull(), i))
        return F.struct(i.alias("id"), block.alias("block"), F.get("lens", k).alias("len"), F.slice("places", start + 1, F.get("ends", k) - start).alias("at"))

    return packs.select("segment", "term", "word", "field", F.explode(F.transform("ids", one)).alias("p")).select("segment", "term", "word", "field", "p.*")


def gram_list(word: Column) -> Column:
    """Different parts of three letters of a word between its ends."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - 2, F.lit(1))), lambda i: F.substring(marked, i, F.lit(3))))


def pattern_grams(pattern: str) -> list[str]:
    """The parts that each word of the pattern must have."""
    runs = [r for r in re.split(r"[*?]", f"^{pattern}$")]
    return sorted({r[k : k + 3] for r in runs for k in range(len(r) - 2)})


def pattern_regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


class TermIndex:
    """An index under a folder that all executors share. fields: text columns; id_col and block_col as in the documents."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.state = self._read()

    # --- manifest

    def _numbers(self) -> list[int]:
        at = self.path(f"{self.root}/manifest")
        return sorted(int(f.getPath().getName()[:-5]) for f in self.fs.listStatus(at) if f.getPath().getName().endswith(".json")) if self.fs.exists(at) else []

    def _read(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "segments": [], "dead": [], "sizes": {}, "fields": []}
        stream = self.fs.open(self.path(f"{self.root}/manifest/{numbers[-1]:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        """Fails if another writer has committed meanwhile: files are never overwritten."""
        number = self.state["number"] + 1
        part, final = (self.path(f"{self.root}/manifest/{x}") for x in (f"{number:08d}.part", f"{number:08d}.json"))
        stream = self.fs.create(part, True)
        stream.write(json.dumps(state | {"number": number}).encode())
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(part, final):
            raise RuntimeError(f"manifest {number} exists: the index was changed by another writer")
        self.state = state | {"number": number}

    # --- tables

    def _rows(self, table: str, live: bool = True) -> DataFrame:
        """A table's rows in the segments that count, without blocks that a later segment replaces."""
        rows = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*(f"{self.root}/{table}/segment={s}" for s in self.state["segments"]))
        return self._live(rows) if live else rows

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self.state["dead"]:
            return rows
        dead = self.spark.read.option("basePath", f"{self.root}/dead").parquet(*(f"{self.root}/dead/segment={s}" for s in self.state["dead"]))
        last = dead.groupBy(F.col("block").alias("gone")).agg(F.max("segment").alias("by"))
        return rows.join(last, (F.col("block") == F.col("gone")) & (F.col("segment") < F.col("by")), "left_anti")

    def _write(self, rows: DataFrame, table: str, segment: int, key: str | None, order: list[str]) -> None:
        at = f"{self.root}/{table}/segment={segment}"
        if key is None:
            rows.write.mode("overwrite").parquet(at)
            return
        parts = rows.withColumn("bucket", bucket_of(F.col(key))).repartition("bucket").sortWithinPartitions("bucket", *order)
        parts.write.mode("overwrite").partitionBy("bucket").parquet(at)

    def _sizes(self, docs: DataFrame) -> dict[str, list[int]]:
        """Documents that have words in a field and their number: one row for each field."""
        return {r.field: [r.n, r.total] for r in docs.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total")).collect()}

    # --- changes

    def update(self, docs: DataFrame, fields: list[str], id_col: str = "id", block_col: str = "_root_", removed: DataFrame | None = None, grams: bool = True) -> TermIndex:
        """Puts in the blocks of these documents, each in place of all that the index has of it; removed: a column of blocks to take out."""
        segment = self.state["number"] + 1
        if self.state["segments"]:
            keys = docs.select(F.col(block_col).cast("string").alias("block"))
            if removed is not None:
                keys = keys.unionByName(removed.select(F.col(removed.columns[0]).cast("string").alias("block")))
            self._write(keys.where("block is not null").distinct(), "dead", segment, None, [])
        gone = None
        if self.state["segments"]:
            gone = self._rows("docs").join(self.spark.read.parquet(f"{self.root}/dead/segment={segment}"), "block", "left_semi")
        self._write(forward(docs, fields, id_col, block_col), "docs", segment, None, [])
        made = self.spark.read.parquet(f"{self.root}/docs/segment={segment}")
        self._write_postings(made, segment)
        words = self.spark.read.parquet(f"{self.root}/postings/segment={segment}").groupBy("word", "term", "field").agg(F.sum("n").alias("n"))
        if gone is not None:
            less = gone.select("field", F.explode(F.array_distinct("words")).alias("word")).groupBy("word", "field").agg((-F.count(F.lit(1))).alias("n")).select("word", stem_column(F.col("word")).alias("term"), "field", "n")
            words = words.unionByName(less).groupBy("word", "term", "field").agg(F.sum("n").alias("n")).where("n != 0")
        self._write(words, "words", segment, "word", ["word"])
        grams = grams and self.state.get("grams", True)
        if grams:
            self._write_grams("postings", segment)
        sizes = {f: list(v) for f, v in self.state["sizes"].items()}
        for found, sign in ((self._sizes(made), 1), (self._sizes(gone) if gone is not None else {}, -1)):
            for f, (n, total) in found.items():
                old = sizes.get(f, [0, 0])
                sizes[f] = [old[0] + sign * n, old[1] + sign * total]
        dead = [*self.state["dead"], segment] if self.state["segments"] else []
        self._commit({"segments": [*self.state["segments"], segment], "dead": dead, "sizes": sizes, "fields": sorted({*self.state["fields"], *fields}), "grams": grams})
        return self

    def _write_postings(self, forward_rows: DataFrame, segment: int) -> None:
        packs = forward_rows.select("id", "block", "field", "len", "words", "at").mapInArrow(_packs, _PACKS)
        self._write(packs.withColumn("term", stem_column(F.col("word"))), "postings", segment, "term", ["term", "field", "word"])

    def _write_grams(self, table: str, segment: int) -> None:
        kept = self.spark.read.parquet(f"{self.root}/{table}/segment={segment}").select("word", "term").distinct()
        self._write(kept.select("word", "term", F.explode(gram_list(F.col("word"))).alias("gram")), "grams", segment, "gram", ["gram", "word"])

    def compact(self) -> TermIndex:
        """Rewrites what counts as one segment; the old files stay for readers of older manifests until clean()."""
        segment, grams = self.state["number"] + 1, self.state.get("grams", True)
        self._write(self._rows("docs").drop("segment"), "docs", segment, None, [])
        self._write_postings(self.spark.read.parquet(f"{self.root}/docs/segment={segment}"), segment)
        words = self._rows("words", live=False).groupBy("word", "term", "field").agg(F.sum("n").alias("n")).where("n > 0")
        self._write(words, "words", segment, "word", ["word"])
        if grams:
            self._write_grams("words", segment)
        self._commit({"segments": [segment], "dead": [], "sizes": self.state["sizes"], "fields": self.state["fields"], "grams": grams})
        return self

    def clean(self) -> None:
        """Deletes segments and manifests that the last manifest does not need."""
        keep = {f"segment={s}" for s in [*self.state["segments"], *self.state["dead"]]}
        for table in ("postings", "words", "grams", "docs", "dead"):
            at = self.path(f"{self.root}/{table}")
            for f in self.fs.listStatus(at) if self.fs.exists(at) else ():
                if f.getPath().getName() not in keep:
                    self.fs.delete(f.getPath(), True)
        for number in self._numbers()[:-1]:
            self.fs.delete(self.path(f"{self.root}/manifest/{number:08d}.json"), False)

    # --- what a search reads

    def _picked(self, table: str, column: str, values: list[str], live: bool = True) -> DataFrame:
        """Rows of some keys: their buckets by the folders' names, their rows by the files' statistics."""
        if not values:
            return self._rows(table, live).where("false")
        return self._rows(table, live).where(F.col("bucket").isin(*(bucket_of(F.lit(v)) for v in values)) & F.col(column).isin(*values))

    def hits(self, terms: list[str], patterns: list[str], fields: list[str]) -> DataFrame:
        """(id, field, len, term, at) of stems, and of patterns under their own text as the term."""
        # A document's words of one stem, or of one pattern, are one hit.
        shape = lambda packs, label: self._live(_unpacked(packs)).select("id", "field", "len", label.alias("term"), "at", "block").groupBy("id", "block", "field", "len", "term").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at")).drop("block")
        out = shape(self._picked("postings", "term", terms, live=False).where(F.col("field").isin(*fields)), F.col("term"))
        for pattern in patterns:
            words = self.words_like(pattern).select("term", "word", bucket_of(F.col("term")).alias("bucket"))
            packs = self._rows("postings", live=False).where(F.col("field").isin(*fields)).join(words, ["bucket", "term", "word"], "left_semi")
            out = out.unionByName(shape(packs, F.lit(pattern)))
        return out

    def words_like(self, pattern: str) -> DataFrame:
        """(word, term) of the words that fit a pattern with * and ?, by their three-letter parts where the pattern has some."""
        grams = pattern_grams(pattern)
        if grams and self.state.get("grams", True):
            rows = self._picked("grams", "gram", grams, live=False).groupBy("word", "term").agg(F.countDistinct("gram").alias("k")).where(F.col("k") == len(grams))
        else:
            rows = self._rows("words", live=False)
        return rows.where(F.col("word").rlike(pattern_regex(pattern))).select("word", "term").distinct()

    def sizes(self, fields: list[str]) -> DataFrame:
        """(field, n, mean) from the manifest."""
        rows = [(f, n, total / n if n else None) for f, (n, total) in self.state["sizes"].items() if f in fields]
        return self.spark.createDataFrame(rows, "field string, n long, mean double")

    def dictionary(self, fields: list[str] | None = None) -> DataFrame:
        """(term, freq): each word with the number of documents' fields that hold it."""
        rows = self._rows("words", live=False)
        rows = rows.where(F.col("field").isin(*fields)) if fields else rows
        return rows.groupBy(F.col("word").alias("term")).agg(F.sum("n").alias("freq")).where("freq > 0")
