"""Breadth-first expansion of a crawl frontier over stored links, and times that a text names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.functions import urls as U


def frontier_expand(seeds: DataFrame, links: DataFrame, max_depth: int = 3, max_pages: int = 100, per_page: int = 50) -> DataFrame:
    """(seed, url, depth): pages reached from each seed over links (src, dst, ord, kind) of the same site, at most `max_pages` a seed.

    Sinks are left out; a link of kind "pagination" keeps the depth (once a round), others add one; the first `per_page` links of a page count.
    Pages over the budget are those last in (depth, url). The loop runs over rounds, never over rows.
    """
    n = F.row_number().over(Window.partitionBy("src").orderBy("ord", "dst"))
    e = links.where(U.sink_reason(F.col("dst")).isNull() & (U.host_key(F.col("src")) == U.host_key(F.col("dst")))).withColumn("n", n).where(F.col("n") <= per_page)
    e = e.select("src", "dst", F.when(F.col("kind") == "pagination", 0).otherwise(1).alias("step"))
    seen = seeds.select(F.col("url").alias("seed"), "url", F.lit(0).alias("depth"))
    edge = seen
    for _ in range(max_depth):
        nxt = edge.join(e, edge["url"] == e["src"]).select("seed", F.col("dst").alias("url"), (F.col("depth") + F.col("step")).alias("depth")).where(F.col("depth") <= max_depth)
        nxt = nxt.groupBy("seed", "url").agg(F.min("depth").alias("depth"))
        edge = nxt.join(seen.select("seed", "url"), ["seed", "url"], "left_anti")
        seen = seen.unionByName(edge)
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "url"))
    return seen.withColumn("r", rank).where(F.col("r") <= max_pages).drop("r")


_MONTHS = "january february march april may june july august september october november december".split()


def temporal_mentions(df: DataFrame, reference: Column, key: str = "doc_id", body: str = "text", most: int = 10, scan: int = 5000) -> DataFrame:
    """(key, ord, raw, at): the first `most` dates in the first `scan` characters: 2024-01-02, 2 January 2024, N hours or days ago (before `reference`)."""
    pattern = rf"(?i)\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}} (?:{'|'.join(_MONTHS)}) \d{{4}}\b|\b\d{{1,4}} (?:hour|day)s? ago\b"
    d = df.select(key, reference.alias("ref"), F.posexplode(F.slice(F.regexp_extract_all(F.substring(body, 1, scan), F.lit(pattern), F.lit(0)), 1, most)).alias("ord", "raw"))
    n = F.regexp_extract("raw", r"^(\d+)", 1).cast("int")
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.regexp_extract("raw", r" (\p{L}+) ", 1))).cast("int")
    named = F.to_timestamp(F.concat_ws("-", F.regexp_extract("raw", r"(\d{4})$", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(n.cast("string"), 2, "0")))
    ago = F.col("ref") - F.when(F.col("raw").rlike("(?i)hour"), F.make_dt_interval(F.lit(0), n)).otherwise(F.make_dt_interval(n))
    at = F.when(F.col("raw").rlike(r"(?i) ago$"), ago).when(F.col("raw").rlike(r"^\d{4}-"), F.col("raw").try_cast("timestamp")).otherwise(named)
    return d.select(key, "ord", "raw", at.alias("at"))


def document_time(updated: Column, published: Column, mentioned: Column) -> Column:
    """When a document is of: its update, else its publication, else the earliest date it names."""
    return F.coalesce(updated, published, mentioned)
