"""Shared folder, table cuts, free column names and connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Per application: the folder of a local run without spark.checkpoint.dir, and the tables written so far.
_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
#: The scopes entered, innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a new local folder in a session of one process (tests); on a cluster an error, as executors would not see a local one.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='spark-docwatch-')}"
    return _LOCAL[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a new table in the shared folder and read it again: lineage ends there, lost executors don't matter.

    The table belongs to the innermost `scope` that is entered, if any.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docwatch/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope():
    """Gather the tables that `cut` writes while this is entered: `with scope() as own`. `drop(spark, own)` deletes these and no others."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield own
    finally:
        _SCOPES.reset(token)


def drop(spark: SparkSession, tables: list[str]) -> None:
    """Delete tables that `cut` wrote. Results that still read them must be written first."""
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in list(tables):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in written:
            written.remove(path)
    if tables is not written:
        tables.clear()


def clear(spark: SparkSession) -> None:
    """Delete all tables that `cut` wrote in this application, whoever reads them still. For the end of a session's work."""
    drop(spark, _WRITTEN.get(spark.sparkContext.applicationId, []))


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """For each of `names` a column name that `df` doesn't have, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df` (a written table) marked for broadcast if it has at most `rows` rows, counted first; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Label (node, label) of every node of `edges` (a long, b long): the least node of its component.

    Alternating large-star and small-star steps: each is one aggregate for the least neighbour
    (combined before the shuffle) and one join, so a hub with millions of links never meets in
    one task whole. Rounds grow with the logarithm of the longest chain; it stops when only stars
    are left, and raises if `rounds` were not enough rather than return a wrong answer.
    """
    spark = edges.sparkSession
    if not edges.take(1):
        return spark.createDataFrame([], "node long, label long")
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        j = e.join(least, "u")
        e = cut(
            j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(j.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "edges",
        )
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("u"), F.lit(0).alias("v")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("u"), F.lit(1).alias("v")))
        if not ends.groupBy("x").agg(F.sum("u").alias("u"), F.max("v").alias("v")).where("u > 1 OR u = 1 AND v = 1").limit(1).count():
            # every node points to one other, which points nowhere
            labels = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (node, label, as `components` gives them) after further `links` (a, b) are added; a written table. Only the components that the links join are labelled anew."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b")
    new = cut(components(ends), "labels")
    again = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return cut(again.union(new.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")
