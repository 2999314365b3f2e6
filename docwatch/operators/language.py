"""Language of texts by script and by the frequent words of a profile table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.functions import text as X

#: Scripts and the language taken for each.
SCRIPTS = (("Devanagari", "hi"), ("Bengali", "bn"), ("Tamil", "ta"), ("Telugu", "te"), ("Gujarati", "gu"), ("Kannada", "kn"), ("Malayalam", "ml"), ("Gurmukhi", "pa"))


def profiles(labelled: DataFrame, language: str, body: str = "text", words: int = 100) -> DataFrame:
    """(word, language): the `words` most frequent words of each language, by the number of texts that hold them."""
    w = labelled.select(F.col(language).alias("language"), F.explode(F.array_distinct(X.words(F.col(body)))).alias("word"))
    n = w.groupBy("language", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.col("n").desc(), "word"))
    return n.withColumn("r", rank).where(F.col("r") <= words).select("word", "language")


def detect_language(df: DataFrame, profile: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, language, route): unknown below 20 characters; by script; else the profile with most words of the text. Route is indic or english.

    `profile` has a hundred words for each language, so it goes to all tasks.
    """
    script = F.lit(None).cast("string")
    for name, code in reversed(SCRIPTS):
        script = F.when(F.col(body).rlike(rf"\p{{Is{name}}}"), code).otherwise(script)
    d = df.select(key, F.length(F.trim(F.col(body))).alias("size"), script.alias("script"), X.words(F.col(body)).alias("ws"))
    hits = d.select(key, F.explode("ws").alias("word")).join(F.broadcast(profile), "word").groupBy(key, "language").agg(F.count("*").alias("n"))
    best = hits.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "language")).alias("b")).select(key, F.col("b.language").alias("guess"))
    j = d.drop("ws").join(best, key, "left")
    code = F.when(F.coalesce("size", F.lit(0)) < 20, "unknown").otherwise(F.coalesce("script", "guess", F.lit("unknown")))
    return j.select(key, code.alias("language"), F.when(code.isin([c for _, c in SCRIPTS]), "indic").otherwise("english").alias("route"))
