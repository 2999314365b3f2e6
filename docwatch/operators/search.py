"""Search over documents: filters, inverted index, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.functions import text as X


def inverted_index(df: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Postings (term, key, tf, length): one row for each term of each document. Counted per document before the shuffle."""
    w = df.select(key, X.words(F.col(body)).alias("ws"))
    w = w.select(key, F.size("ws").alias("length"), F.explode("ws").alias("term"))
    return w.groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def bm25(df: DataFrame, terms: list[str], key: str = "doc_id", body: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents with every term, scored by BM25 with the numbers and mean length of all documents of `df`.

    Terms are counted inside each document's array of words, so no row a word is made and nothing but one row of statistics moves.
    """
    wanted = sorted({t.lower() for t in terms})
    ws = df.select(key, X.words(F.col(body)).alias("ws"))
    times = lambda w: F.size(F.filter("ws", lambda x: x == F.lit(w)))
    t = ws.select(key, F.size("ws").alias("length"), *[times(w).alias(f"tf{i}") for i, w in enumerate(wanted)])
    held = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]
    stats = t.agg(F.count("*").alias("documents"), F.avg("length").alias("mean_length"), *held)
    every = t
    for i in range(len(wanted)):
        every = every.where(F.col(f"tf{i}") > 0)
    j = every.crossJoin(F.broadcast(stats))
    norm = k1 * (1 - b + b * F.col("length") / F.col("mean_length"))
    parts = [F.log(F.lit(1.0) + (F.col("documents") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + norm) for i in range(len(wanted))]
    return j.select(key, sum(parts, F.lit(0.0)).alias("score"))


def search_documents(df: DataFrame, equal: dict[str, str] | None = None, start: Column | None = None, end: Column | None = None, at: str = "collected_at", order: list[Column] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of the rows that pass the filters, with total (the number of all that pass) on each."""
    out = df
    for c, v in (equal or {}).items():
        out = out.where(F.col(c) == v)
    if start is not None:
        out = out.where(F.col(at) >= start)
    if end is not None:
        out = out.where(F.col(at) <= end)
    total = out.agg(F.count("*").alias("total"))
    page = out.orderBy(*(order or [F.col(at).desc()])).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))


def snippet(body: Column, query: str, width: int = 240, lead: int = 80) -> Column:
    """`width` characters around the first term of `query` found in `body`, with ellipses where text is left out; the beginning if none is found."""
    low = F.lower(body)
    places = [F.nullif(F.instr(low, F.lit(t)), F.lit(0)) for t in dict.fromkeys(query.lower().split())]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1)) if places else F.lit(1)
    start = F.greatest(F.lit(1), first - lead)
    piece = F.trim(F.substr(body, start, F.lit(width)))
    return F.concat(F.when(start > 1, "…").otherwise(""), piece, F.when(F.length(body) >= start + width, "…").otherwise(""))


def substring_search(df: DataFrame, q: str, fields: list[str]) -> DataFrame:
    """Rows with the literal `q` in any field, whatever the case."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f)), F.lit(q.lower())), F.lit(False))
    return df.where(hit)


def relevant_results(results: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """Results (query_id, rank, title, snippet, url) that hold their query's term (query_id, term), the first `top` of each query, one of each URL."""
    j = results.join(queries, "query_id")
    text = F.lower(F.concat_ws(" ", "title", "snippet", "url"))
    j = j.where(F.contains(text, F.lower("term")))
    j = j.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "url"))).where(F.col("n") <= top)
    first = Window.partitionBy("url").orderBy("query_id", "rank")
    return j.withColumn("m", F.row_number().over(first)).where("m = 1").select("query_id", "rank", "url")


def engine_summary(responses: DataFrame, group: str) -> DataFrame:
    """Engines that answered and engines that only failed, per group."""
    return responses.groupBy(group).agg(
        F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("engine")))).alias("answered"),
        F.array_sort(F.array_except(F.collect_set("engine"), F.collect_set(F.when(F.col("ok"), F.col("engine"))))).alias("failed"),
    )
