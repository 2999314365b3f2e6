"""Who encloses whom in a page's tree, by one pass in the order of the nodes rather than by joins of intervals.

A node's descendants are the nodes from node_id to last_desc, so nodes of a kind are nested intervals. Work is linear in a page's nodes (after sorting them), however many
containers it has and however deep they nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def enclosing(nodes: DataFrame, match: Column, out: str) -> DataFrame:
    """`nodes` (page_id, node_id, last_desc, ...) with `out`: the node_id of the nearest one for which `match` holds, the node itself or an ancestor; null if there is none.

    Openings and ends of matching nodes are counted along the page, which gives each node's level of nesting. Of one level no two are open at once, so
    the nearest one is the last that was opened on the node's own level.
    """
    hit = F.coalesce(match, F.lit(False))
    opened = nodes.withColumns({"at_": F.col("node_id"), "own_": F.lit(1), "hit_": hit})
    closed = opened.where("hit_").withColumns({"at_": F.col("last_desc") + 1, "own_": F.lit(0)})
    step = F.when(F.col("hit_"), F.when(F.col("own_") == 1, 1).otherwise(-1)).otherwise(0)
    along = Window.partitionBy("page_id").orderBy("at_", "own_").rowsBetween(Window.unboundedPreceding, 0)
    level = opened.unionByName(closed).withColumn("level_", F.sum(step).over(along)).where("own_ = 1")
    here = Window.partitionBy("page_id", "level_").orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
    near = F.when(F.col("level_") > 0, F.last(F.when(F.col("hit_"), F.col("node_id")), True).over(here))
    return level.withColumn(out, near).select(*[c for c in nodes.columns if c != out], out)


def subtree_sums(nodes: DataFrame, **values: Column) -> DataFrame:
    """`nodes` with a column for each of `values`: its sum over the node and all its descendants, from running sums along the page; null counts 0."""
    along = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    own = nodes.withColumns({f"{v}_own_": F.coalesce(c, F.lit(0)).cast("long") for v, c in values.items()})
    run = own.withColumns({f"{v}_run_": F.sum(f"{v}_own_").over(along) for v in values})
    ends = run.select(F.col("page_id").alias("page_"), F.col("node_id").alias("end_"), *[F.col(f"{v}_run_").alias(f"{v}_end_") for v in values])
    both = run.join(ends, (F.col("page_id") == F.col("page_")) & (F.col("last_desc") == F.col("end_")))
    return both.select(*[c for c in nodes.columns if c not in values], *[(F.col(f"{v}_end_") - F.col(f"{v}_run_") + F.col(f"{v}_own_")).alias(v) for v in values])
