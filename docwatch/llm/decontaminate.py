"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

An item is found in a document if the document holds at least percent/100 of the item's
distinct shingles (five words, A-Z lower-cased; an item of fewer words is one shingle of them all, looked for
at that width). The items are partitioned by size, in bands of a factor of 1.4. A band has its own sketch: the k smallest shingles under one hash
order (bottom-k MinHash), k being 2 m + 1 for the m shingles that the largest item of the band may lack (all shingles of an item that has fewer).
Of an item that may lack m' of its shingles a document that holds it holds k - m' of the sketch at least, which is the
band's test for candidates: the search misses none, however long the document is. Documents send only the shingles
that occur in the sketch table and then, for candidates, those that occur in an item, which are counted exactly.

The sketch table goes to the tasks if it has at most `small` entries of 8 bytes, the items' other shingles if they are at most four times as many (both
are counted first, and fetched as Arrow columns); those of a
larger benchmark are joined by shuffles of the documents' shingles that are not above the largest sketch value.

Null or empty items are found nowhere, null or empty texts hold nothing, repeated items and documents each give
their rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docwatch.llm.common import cut, fresh
from docwatch.llm.shingles import U, column_bytes, shingle_sets, slices, word_hashes


#: A band's largest size over its smallest.
BAND = 1.4


def _item_rows(width: int):
    def run(batches):
        for b in batches:
            out = []
            ids = b.column("item_key").to_pylist()
            texts = column_bytes(b.column("text"))
            for lo, hi in slices(texts):
                words, counts = word_hashes(texts[lo:hi])
                for i, c, s in zip(range(lo, hi), counts.tolist(), shingle_sets(words, counts, width)):
                    out += [(ids[i], min(c, width), s.size, h) for h in s.view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], ["item_key", "width", "q", "h"])

    return run


def _doc_rows(widths: list[int], wanted: np.ndarray | None, below: dict[int, int] | None):
    """Rows (doc_id, dkey, width, h) of the distinct shingles of whole texts that are in `wanted`, or in order under `below`."""

    def run(batches):
        for b in batches:
            texts = column_bytes(b.column("text"))
            where, kinds, found = [], [], []
            for lo, hi in slices(texts):
                words, counts = word_hashes(texts[lo:hi])
                for width in widths:
                    long_enough = counts >= width
                    for i, s in enumerate(shingle_sets(words, counts, width)):
                        if not long_enough[i]:
                            continue
                        if wanted is not None:
                            s = s[wanted[np.minimum(np.searchsorted(wanted, s), wanted.size - 1)] == s]
                        elif below is not None:
                            s = s[s.view(np.int64) <= below[width]]
                        if s.size:
                            where.append(np.full(s.size, lo + i))
                            kinds.append(np.full(s.size, width))
                            found.append(s.view(np.int64))
            if where:
                at = pa.array(np.concatenate(where))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("dkey").take(at), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(found))], ["doc_id", "dkey", "width", "h"])

    return run


def _column(grams: DataFrame) -> np.ndarray:
    """The distinct shingles of `grams`, sorted; the caller has bounded their number."""
    return np.sort(grams.select("h").distinct().toArrow().column("h").to_numpy().view(U))


def containments(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, small: int = 500_000) -> DataFrame:
    """Pairs of document and item: doc_id, dkey (hash of the text), item_id, item_shingles, shared, containment."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = cut(items.withColumn("item_key", F.xxhash64("item_id", "text")).dropDuplicates(["item_key"]), "items")
    grams = items.select("item_key", "text").mapInArrow(_item_rows(width), "item_key long, width long, q long, h long")
    # bottom-k sketch: the place of each shingle in the item's hash order; one item is a bounded group
    order = Window.partitionBy("item_key").orderBy("h")
    lack = lambda q: F.floor(q * (100 - percent) / 100).cast("long")
    grams = grams.withColumn("place", F.row_number().over(order)).withColumn("band", F.floor(F.log(F.col("q").cast("double")) / F.log(F.lit(BAND))))
    largest = F.ceil(F.pow(F.lit(BAND), F.col("band") + 1)).cast("long")
    k = F.least(F.col("q"), 2 * lack(largest) + 1)
    grams = cut(grams.withColumns({"sketch": F.col("place") <= k, "least": k - lack(F.col("q"))}), "grams")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "dkey", "width", "h")])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where(F.col("text").isNotNull()).withColumn("dkey", F.xxhash64("text"))
    widths = sorted(r["width"] for r in grams.select("width").distinct().collect())  # at most `width` of them
    if grams.where("sketch").limit(small + 1).count() <= small:
        table = _column(grams.where("sketch"))
        told = docs.sparkSession.sparkContext.broadcast(table)
        hits = docs.mapInArrow(lambda b: _doc_rows(widths, told.value, None)(b) if len(told.value) else iter(()), schema)
        every_gram = grams.limit(4 * small + 1).count() <= 4 * small
    else:
        below = {r["width"]: r["most"] for r in grams.where("sketch").groupBy("width").agg(F.max("h").alias("most")).collect()}
        hits, every_gram = docs.mapInArrow(_doc_rows(widths, None, below), schema), False
    sketch = grams.where("sketch").select("h", "width", "item_key", "q", "least")
    pairs = hits.join(sketch, ["h", "width"]).groupBy("doc_id", "dkey", "item_key").agg(F.first("q").alias("q"), F.first("width").alias("width"), F.first("least").alias("least"), F.count("*").alias("c"))
    pairs = cut(pairs.where("c >= least").drop("c", "least"), "pairs")
    # exact count: all shingles of the candidate documents that any item has
    found = docs.join(pairs.select(F.col("doc_id").alias("d"), F.col("dkey").alias("k")).distinct(), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("dkey") == F.col("k")), "left_semi")
    found = found.dropDuplicates(["doc_id", "dkey"])
    if every_gram:
        known = docs.sparkSession.sparkContext.broadcast(_column(grams))
        held = found.mapInArrow(lambda b: _doc_rows(widths, known.value, None)(b) if len(known.value) else iter(()), schema)
    else:
        held = found.mapInArrow(_doc_rows(widths, None, None), schema)
    held = held.withColumnRenamed("doc_id", "d")
    grams_of = pairs.join(grams.select("item_key", "h"), "item_key")
    shared = grams_of.join(held, (F.col("doc_id").eqNullSafe(F.col("d"))) & (grams_of["dkey"] == held["dkey"]) & (grams_of["h"] == held["h"]) & (grams_of["width"] == held["width"]))
    shared = shared.select(grams_of["doc_id"], grams_of["dkey"], "item_key", "q").groupBy("doc_id", "dkey", "item_key").agg(F.first("q").alias("q"), F.count("*").alias("shared"))
    whole = shared.where(F.col("shared") * 100 >= F.col("q") * percent).join(items.select("item_key", "item_id"), "item_key")
    return whole.select("doc_id", "dkey", "item_id", F.col("q").alias("item_shingles"), "shared", (F.col("shared") / F.col("q")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the rows in which an item is found; columns unchanged."""
    d, k = fresh(docs, "d", "k")
    found = containments(docs, items, width, percent).select(F.col("doc_id").alias(d), F.col("dkey").alias(k)).distinct()
    held = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(k))
    return docs.join(found, held, "left_anti")
