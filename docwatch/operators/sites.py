"""Jobs over URLs and hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwatch.functions import urls as U


def registrable_domain(df: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """`df` with host and site: the public suffix (a table with one column, suffix) and one more label, else the host itself.

    Hosts are made distinct first, so the labels of each host are joined once, whatever the number of its pages.
    """
    d = df.withColumn("host", U.extract_domain(F.col(url)))
    hosts = d.select("host").distinct().withColumn("parts", F.split("host", r"\."))
    cut = hosts.where(F.size("parts") > 1).select("host", "parts", F.explode(F.sequence(F.lit(2), F.size("parts"))).alias("i"))
    tail = lambda i: F.array_join(F.slice("parts", i, F.size("parts")), ".")
    cut = cut.select("host", "i", tail(F.col("i")).alias("suffix"), tail(F.col("i") - 1).alias("site"))
    best = cut.join(suffixes, "suffix").groupBy("host").agg(F.min_by("site", "i").alias("site"))
    return d.join(best, "host", "left").withColumn("site", F.coalesce("site", "host"))
