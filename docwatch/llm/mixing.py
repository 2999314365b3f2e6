"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Sizes are words. The sources share `share` times all words by weight; a target stops at `most` times
its source's size and the excess is shared again by weight until none is above. Within a source every
document expects r = target / source size copies. The documents are put in one order, the
expected copies are summed along it, one offset u (a hash of the source's name and the seed) is added, and a document is emitted
once per integer boundary its own stretch crosses: floor(r i + u) - floor(r (i-1) + u) times
for the i-th. Ordered by size class, each class is sampled evenly, so the words taken come near the target.

The place i of a document is found without a window over a whole source: (source, size class, hash
range) buckets of bounded size are counted, the counts are summed over the small bucket table, and
row_number runs inside each bucket. Bucket ranges follow the order, so the result doesn't depend on how many there are.

Null text: size 0. Null source: a source of its own, the last. Sources of no words: target 0. Ties in size, hash and doc_id are broken by the text's hash; rows equal in
all of these are interchangeable. `mix` carries extra columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.llm.common import cut, fresh, if_small

#: Rows of a bucket, at least; and how many buckets there are at most, besides one for each source and size class.
BUCKET, BUCKETS = 256, 20_000


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, target) of a table with a row for each source (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    t = t.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    # the sources whose cap is least for their weight are full first
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    t = t.withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    level = F.coalesce(F.max(F.when(~F.col("capped"), F.struct(-F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"], F.lit(0.0))
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * level).alias("target"))


def sample(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """A row for each row of `docs`: doc_id, source, mix_text (hash of the text), mix_size, mix_source_size, mix_target, mix_copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 8), 16, 10).cast("long")
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("mix_text"), size.alias("mix_size"), hashed.alias("mix_hash"))
    rows = cut(rows.withColumn("mix_class", F.floor(F.log(F.col("mix_size") + F.lit(1.0)) * 8).cast("long")), "sizes")
    classes = cut(rows.groupBy("source", "mix_class").agg(F.count("*").alias("n"), F.sum("mix_size").alias("size")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    bucket = max(BUCKET, math.ceil(total / BUCKETS))
    per_source = _targets(classes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    ahead = Window.partitionBy("source").orderBy("mix_class").rowsBetween(Window.unboundedPreceding, -1)
    info = classes.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    info = info.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    info = info.select(F.col("source").alias("i_source"), F.col("mix_class").alias("i_class"), F.ceil(F.col("n") / bucket).alias("parts"), "before", "source_size", "target")
    info = if_small(cut(info, "targets"))
    rows = rows.join(info, F.col("source").eqNullSafe(F.col("i_source")) & (F.col("mix_class") == F.col("i_class"))).drop("i_source", "i_class")
    rows = rows.withColumn("mix_part", F.floor(F.col("mix_hash") * F.col("parts") / F.lit(4294967296)).cast("long")).drop("parts")
    buckets = rows.groupBy("source", "mix_class", "mix_part").agg(F.count("*").alias("n"))
    running = Window.partitionBy("source", "mix_class").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("source").alias("b_source"), F.col("mix_class").alias("b_class"), F.col("mix_part").alias("b_part"), F.coalesce(F.sum("n").over(running), F.lit(0)).alias("inside"))
    buckets = if_small(cut(buckets, "buckets"))
    rows = rows.join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("mix_class") == F.col("b_class")) & (F.col("mix_part") == F.col("b_part")))
    order = Window.partitionBy("source", "mix_class", "mix_part").orderBy("mix_hash", F.col("doc_id").asc_nulls_first(), "mix_size", "mix_text")
    place = F.col("before") + F.col("inside") + F.row_number().over(order)
    name = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("place", place)
    copies = F.floor(rate * F.col("place") + offset) - F.floor(rate * (F.col("place") - 1) + offset)
    return rows.select("doc_id", "source", "mix_text", "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies.cast("long").alias("mix_copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as it is taken (not at all, once or more), columns unchanged.

    The counts are found on narrow rows; the texts move once, to meet them. Rows equal in doc_id, source and text are told apart by a number.
    """
    doc, src, text, nth, copies, copy = fresh(docs, "doc", "src", "text_key", "nth", "copies", "copy")
    key = [doc, src, text]
    again = Window.partitionBy(*key).orderBy(F.lit(0))
    source = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null"))
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    taken = sample(docs, **how).select(named.alias(doc), source.alias(src), F.col("mix_text").alias(text), F.col("mix_copies").alias(copies))
    taken = taken.withColumn(nth, F.row_number().over(again)).where(F.col(copies) > 0)
    full = docs.withColumns({doc: named, src: source, text: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    full = full.withColumn(nth, F.row_number().over(again)).join(taken, [*key, nth])
    return full.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
