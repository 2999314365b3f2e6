"""Files as tables: unified dumps, Atom feeds, sitemaps, robots texts, raw artifacts, raw evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.functions import urls as U

ATOM = (
    "id string, title string, author struct<name:string>, link struct<_href:string>, category struct<_term:string>, published string, updated string,"
    " content struct<_VALUE:string>"
)


def read_kind(spark: SparkSession, path: str, kind: str, columns: list[str]) -> DataFrame:
    """One record kind of a unified dump, with its own columns only; filter and columns reach the scan."""
    return spark.read.parquet(path).where(F.col("record_kind") == kind).select(*columns)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of Atom files. Entries without id and link are left out; an id is taken from the link, else from the guid; published falls back to updated."""
    e = spark.read.format("xml").option("rowTag", "entry").option("mode", "PERMISSIVE").schema(ATOM).load(path)
    link = F.col("link._href")
    post = F.coalesce(F.nullif(F.regexp_extract(link, "/comments/([A-Za-z0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract("id", "_([A-Za-z0-9]+)$", 1), F.lit("")))
    return e.where(F.col("id").isNotNull() | link.isNotNull()).select(
        post.alias("id"), F.col("id").alias("guid"), link.alias("url"), F.col("category._term").alias("subreddit"), F.regexp_replace("author.name", "^/u/", "").alias("author"),
        "title", F.col("content._VALUE").alias("content"), F.lit(None).cast("string").alias("flair"), F.coalesce("published", "updated").try_cast("timestamp").alias("published_at"),
    )


def read_sitemaps(spark: SparkSession, path: str, roots: DataFrame, most: int = 500, depth: int = 2) -> DataFrame:
    """(root, loc, lastmod, truncated) of the URL sets reached from `roots` (loc) through at most `depth` levels of indexes.

    The files are named after their location: the file <name>.xml serves every loc that ends with /<name>.xml. At most `most` URLs of a root stay, in order of loc.
    """
    name = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).schema("loc string, lastmod string").load(path).select(name(F.input_file_name()).alias("file"), "loc", "lastmod")
    urls, indexes = read("url"), read("sitemap")
    level = roots.select(F.col("loc").alias("root"), "loc")
    reached = level
    for _ in range(depth):
        level = level.withColumn("file", name(F.col("loc"))).select("root", "file").join(indexes, "file").select("root", "loc")
        reached = reached.unionByName(level)
    found = reached.withColumn("file", name(F.col("loc"))).select("root", "file").distinct().join(urls, "file").groupBy("root", "loc").agg(F.max("lastmod").alias("lastmod"))
    n = F.row_number().over(Window.partitionBy("root").orderBy("loc"))
    all_of = F.count("*").over(Window.partitionBy("root"))
    return found.withColumns({"n": n, "truncated": all_of > most}).where(F.col("n") <= most).select("root", F.trim("loc").alias("loc"), F.to_date(F.substring("lastmod", 1, 10)).alias("lastmod"), "truncated")


def robots_rules(df: DataFrame, agent: str) -> DataFrame:
    """Per host of robots texts (host, text): root_disallowed for `agent` (its own group, else that of *), and the sitemaps."""
    lines = df.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    key = F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1)))
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"^\s*[A-Za-z-]+\s*:(.*)$", 1), r"\s+#.*$", ""))
    lines = lines.select("host", "i", key.alias("k"), value.alias("v")).where("k <> ''")
    w = Window.partitionBy("host").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("agent", F.last(F.when(F.col("k") == "user-agent", F.lower("v")), ignorenulls=True).over(w))
    root = (F.col("k") == "disallow") & (F.col("v") == "/")
    own = F.col("agent") == agent.lower()
    g = lines.groupBy("host").agg(
        F.bool_or(own).alias("has_own"), F.coalesce(F.bool_or(root & own), F.lit(False)).alias("own"), F.coalesce(F.bool_or(root & (F.col("agent") == "*")), F.lit(False)).alias("any"),
        F.array_sort(F.collect_set(F.when(F.col("k") == "sitemap", F.col("v")))).alias("sitemaps"),
    )
    return g.select("host", F.when(F.coalesce("has_own", F.lit(False)), F.col("own")).otherwise(F.col("any")).alias("root_disallowed"), "sitemaps")


def discovery_union(sitemaps: DataFrame, feeds: DataFrame, per_feed: int = 20) -> DataFrame:
    """(domain, url, origin): sitemap URLs, then the first `per_feed` links of each feed, the first of each URL. sitemaps: url, ord; feeds: feed, url, ord."""
    n = F.row_number().over(Window.partitionBy("feed").orderBy("ord"))
    f = feeds.withColumn("n", n).where(F.col("n") <= per_feed)
    both = sitemaps.select("url", F.lit(0).alias("rank"), "ord", F.lit("sitemap").alias("origin")).unionByName(f.select("url", F.lit(1).alias("rank"), "ord", F.lit("feed").alias("origin")))
    first = both.groupBy("url").agg(F.min(F.struct("rank", "ord", "origin")).alias("b"))
    return first.select(U.extract_domain(F.col("url")).alias("domain"), "url", F.col("b.origin").alias("origin"))


def discovery_counts(found: DataFrame) -> DataFrame:
    """(domain, sitemap, feed, status) of `discovery_union`: URLs by origin; status complete with both origins, partial with one."""
    g = found.groupBy("domain").agg(F.count_if(F.col("origin") == "sitemap").alias("sitemap"), F.count_if(F.col("origin") == "feed").alias("feed"))
    return g.withColumn("status", F.when((F.col("sitemap") > 0) & (F.col("feed") > 0), "complete").otherwise("partial"))


def artifact_manifest(df: DataFrame, source: str, crawl: str, page: str, content: str, kind: Column) -> DataFrame:
    """(key, sha256, size, content_type) of raw bytes; the key is source/crawl/page.ext."""
    ext = F.when(kind.contains("html"), "html").when(kind.contains("pdf"), "pdf").when(kind.contains("json"), "json").otherwise("bin")
    b = F.col(content).cast("binary")
    key = F.concat(F.col(source).cast("string"), F.lit("/"), F.col(crawl).cast("string"), F.lit("/"), F.col(page).cast("string"), F.lit("."), ext)
    return df.select(key.alias("key"), F.sha2(b, 256).alias("sha256"), F.octet_length(b).cast("long").alias("size"), kind.alias("content_type"))


def write_raw_evidence(df: DataFrame, path: str) -> None:
    """JSON rows of messages in a folder for each source."""
    df.write.mode("append").partitionBy("source_id").json(path)
