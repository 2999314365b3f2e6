"""Keyword monitoring of feed posts: id, guid, url, subreddit, author, title, content, flair, published_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _terms(terms: list[str]) -> list[str]:
    return list(dict.fromkeys(t for t in (" ".join(x.lower().split()) for x in terms) if t))


def haystack(field: str = "full") -> Column:
    """Lower-cased, collapsed text that terms are looked for in: the title, or title, content and flair."""
    parts = [F.col("title")] if field == "title" else [F.col(c) for c in ("title", "content", "flair")]
    joined = F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")
    return F.lower(F.regexp_replace(joined, r"(?U)\s+", " "))


def _found(text: Column, terms: list[str]) -> Column:
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]))


def match_keywords(posts: DataFrame, keywords: list[str], strong: list[str] = (), exclude: list[str] = (), field: str = "full", min_matches: int = 1) -> DataFrame:
    """`posts` with matched_keywords and signal (any strong term, or `min_matches` keywords); posts with an excluded term are dropped."""
    plain, loud = _terms(list(keywords)), _terms(list(strong))
    p = posts.withColumn("haystack__", haystack(field))
    for t in _terms(list(exclude)):
        p = p.where(~F.contains("haystack__", F.lit(t)))
    p = p.withColumns({"plain__": _found(F.col("haystack__"), plain), "loud__": _found(F.col("haystack__"), loud)})
    signal = (F.size("loud__") > 0) | (F.size("plain__") >= min_matches)
    return p.withColumns({"matched_keywords": F.concat("plain__", F.array_except("loud__", "plain__")), "signal": signal}).drop("haystack__", "plain__", "loud__")


def dedupe_posts(posts: DataFrame, order: list[str]) -> DataFrame:
    """The first post by `order` for each id (else guid, else url); posts without any of them all stay."""
    key = F.coalesce(F.nullif("id", F.lit("")), F.nullif("guid", F.lit("")), F.nullif("url", F.lit("")))
    keyed = posts.withColumn("key__", key)
    w = Window.partitionBy("key__").orderBy(*order)
    first = keyed.where("key__ IS NOT NULL").withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")
    return first.unionByName(keyed.where("key__ IS NULL")).drop("key__")


def date_bounds(posts: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Posts published in [start, end]; a bare end date is the end of that day. Posts without a date are left out where a bound is set."""
    out = posts
    if start:
        out = out.where(F.col("published_at") >= F.lit(start).cast("timestamp"))
    if end:
        last = F.lit(end).cast("timestamp")
        out = out.where(F.col("published_at") < last + F.expr("INTERVAL 1 DAY") if len(end) <= 10 else F.col("published_at") <= last)
    return out


def monitor(posts: DataFrame, keywords: list[str], order: list[str], subreddits: list[str] | None = None, author: str | None = None, start: str | None = None, end: str | None = None, limit: int | None = None, **how) -> DataFrame:
    """Posts of some sources (or an author) that match, deduplicated, in the date range; at most `limit`, newest first."""
    p = posts.where(F.col("subreddit").isin(subreddits)) if subreddits else posts
    p = p.where(F.col("author") == author) if author else p
    p = date_bounds(dedupe_posts(match_keywords(p, keywords, **how), order), start, end)
    return p.orderBy(F.col("published_at").desc_nulls_last(), *order).limit(limit) if limit else p


def event_signal(posts: DataFrame, threshold: int = 10) -> DataFrame:
    """One row over matched posts: detected, post_count, unique_subreddits, matched_keywords (sorted)."""
    words = posts.select("subreddit", F.explode_outer("matched_keywords").alias("w"), F.monotonically_increasing_id().alias("i"))
    return posts.agg(
        (F.count("*") >= threshold).alias("detected"), F.count("*").alias("post_count"), F.countDistinct("subreddit").alias("unique_subreddits"),
    ).crossJoin(F.broadcast(words.where("w IS NOT NULL").agg(F.array_sort(F.collect_set("w")).alias("matched_keywords"))))
