"""Exact top-k inner-product search with multi-resolution segment statistics.

Vectors are cut into 1, 4, 16 and 32 segments. Of each segment the mean and the deviation (norm of what the mean
leaves) are kept. By Cauchy and Schwarz the inner product of a query and a candidate is at most the
sum over segments of length * mean * mean + deviation * deviation; with the norms this
is the usual lower bound of their distance. Inside a tile the bounds run coarse to fine against the
query's k-th best score so far; only survivors of all levels get the exact score (as one dense product where many survive). Nothing is lost: a
pair is skipped only if its bound is below k exact scores. `left_by_level` tells what each level leaves.

Plan: equal rows (of id and vector) are counted and k of them kept at most, which changes no result. Candidates are gathered in blocks of a
bounded size by a hash of the id, vector and copy, queries by one of the id and vector, both in the narrowest integers that hold
the table's values. First all queries meet one block of candidates; the k-th score found there is the floor with which they go to all other
blocks (a stated query set against all rows, in blocks). Each tile returns k rows a
query at most and a window ranks them. Work is queries x rows, spread over tiles of equal size whatever the ids are. All joins are shuffled ones, so nothing that grows
with the rows passes through the driver.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Only
vectors of one length are compared. Equal rows are one query but each a candidate; rows with the query's id are never its
candidates. Ties go to the smaller id. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.llm.common import cut

LEVELS = (1, 4, 16, 32)
QUERIES, CANDIDATES, AT_ONCE = 8192, 8192, 1024
#: Tasks at most that the tiles are dealt to; a task takes its tiles one after the other.
TASKS = 20_000


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite, F.lit(False))


def levels_of(length: int) -> list[int]:
    return [s for s in LEVELS if s < length]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row the scaled means and the deviations of `segments` segments, side by side; their dot product is the bound."""
    parts = np.array_split(np.arange(x.shape[1]), segments)
    out = []
    for p in parts:
        y = x[:, p]
        mean = y.mean(1)
        out += [mean * np.sqrt(len(p)), np.sqrt(np.maximum(((y - mean[:, None]) ** 2).sum(1), 0))]
    return np.stack(out, 1)


def best_of_tile(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, known: np.ndarray | None = None, left: dict[int, int] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the k best candidates of each query in this tile, of those that reach `known`, a score that k others reach.

    `left` gets the pairs that each level leaves (0: all pairs).
    """
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64  # exact in each case
    bound = np.float32 if most < 1 << 24 else np.float64
    qx, cx = q.astype(kind), c.astype(kind)
    order = np.argsort(-np.abs(c.astype(float)).sum(1), kind="stable")
    c_ids, cx = c_ids[order], cx[order]
    segments = levels_of(q.shape[1])
    qf, cf = q.astype(float), c.astype(float)[order]
    of_q = [statistics(qf, s).astype(bound) for s in segments]
    of_c = [statistics(cf, s).astype(bound) for s in segments]
    # what rounding may take from a bound
    slack = 64 * len(LEVELS) * float(np.finfo(bound).eps) * (np.linalg.norm(qf, axis=1).max(initial=0) * np.linalg.norm(cf, axis=1).max(initial=0)) + 1e-6
    floor = np.full(len(q), -np.inf) if known is None else known.astype(float)
    rows, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for lo in range(0, len(cx), AT_ONCE):
        at = slice(lo, lo + AT_ONCE)
        live = c_ids[at][None, :] != q_ids[:, None]
        if left is not None:
            left[0] = left.get(0, 0) + int(live.sum())
        for level, a, b in zip(segments, of_q, of_c):
            if np.isfinite(floor).any():
                cols = live.any(0)
                live[:, cols] &= a @ b[at][cols].T + slack >= floor[:, None]
            if left is not None:
                left[level] = left.get(level, 0) + int(live.sum())
        if live.mean() > 0.05:
            dense = qx @ cx[at].T
            r, j = np.nonzero(live & (dense >= floor[:, None]))
            s = dense[r, j]
        else:
            r, j = np.nonzero(live)
            s = np.concatenate([np.einsum("ij,ij->i", qx[r[i : i + 65536]], cx[at][j[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.empty(0)])
        rows, ids, scores = np.append(rows, r), np.append(ids, c_ids[at][j]), np.append(scores, s.astype(np.int64))
        by = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[by], ids[by], scores[by]
        first = np.searchsorted(rows, np.arange(len(q)))
        keep = np.arange(len(rows)) - first[rows] < k
        rows, ids, scores = rows[keep], ids[keep], scores[keep]
        count = np.bincount(rows, minlength=len(q))
        full = np.flatnonzero(count == k)
        floor[full] = np.maximum(floor[full], scores[np.searchsorted(rows, full, "right") - 1])
    return rows, ids, scores


def left_by_level(x: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int = 20) -> dict[int, float]:
    """Share of the pairs of `asked` rows with all rows that is left after each level, in blocks as `search` runs them."""
    left: dict[int, int] = {}
    floor = None
    for lo in range(0, len(x), CANDIDATES):
        rows, _, scores = best_of_tile(ids[asked], x[asked], ids[lo : lo + CANDIDATES], x[lo : lo + CANDIDATES], k, floor, left if lo else None)
        if floor is None:
            floor = np.array([scores[rows == i].min(initial=np.iinfo(np.int64).max) if (rows == i).sum() == k else -np.inf for i in range(asked.sum())])
    return {level: n / max(1, left[0]) for level, n in left.items()}


def _tiles(k: int):
    def matrix(column, i):
        return np.asarray(column[i].values.flatten()).reshape(len(column[i]), -1)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                q_ids, c_ids, floor = (np.asarray(b.column(n)[i].values) for n in ("q_ids", "c_ids", "q_floor"))
                keys = np.asarray(b.column("q_keys")[i].values)
                rows, ids, scores = best_of_tile(q_ids, matrix(b.column("q_data"), i), c_ids, matrix(b.column("c_data"), i), k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(keys[rows]), pa.array(ids), pa.array(scores)], ["query_id", "q_key", "vec_id", "score"])

    return run


def _met(query: DataFrame, cand: DataFrame, blocks: list[int], tiles: int, k: int) -> DataFrame:
    """query_id, q_key, vec_id, score: the k best of each query in each of the candidate blocks from blocks[0] to blocks[1]."""
    query = query.groupBy("n", "qb").agg(F.collect_list(F.struct("vec_id", "key", "x", "floor")).alias("r"))
    query = query.select("n", "qb", F.col("r.vec_id").alias("q_ids"), F.col("r.key").alias("q_keys"), F.col("r.x").alias("q_data"), F.col("r.floor").alias("q_floor"))
    query = query.withColumn("cb", F.explode(F.sequence(F.lit(blocks[0]), F.lit(blocks[1])).cast("array<bigint>")))
    # sizes of arrays are guessed far too low, so a join by these guesses may send all rows through the driver
    met = query.join(cand.hint("merge"), ["n", "cb"]).repartition(min(tiles, TASKS), "cb", "qb")
    return met.select("q_ids", "q_keys", "q_data", "q_floor", "c_ids", "c_data").mapInArrow(_tiles(k), "query_id long, q_key long, vec_id long, score long")


def search(vectors: DataFrame, asked: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of `vectors` (vec_id, embedding of integers) for each row where `asked` holds."""
    v = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<bigint>").alias("x"), F.coalesce(asked, F.lit(False)).alias("asked"))
    v = v.withColumn("n", F.size("x"))
    # of equal rows no more than k can be among the k best: they are counted, so no block holds more copies of a row
    equal = v.groupBy("vec_id", "n", "x").agg(F.count("*").alias("copies"), F.max("asked").alias("asked")).withColumn("key", F.xxhash64("x"))
    equal = cut(equal.withColumn("copies", F.least("copies", F.lit(k).cast("long"))), "vectors")
    most = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    number = equal.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("c"), F.sum(F.col("asked").cast("long")).alias("q"), F.max(most).alias("most")).first()
    narrow = "array<smallint>" if (number["most"] or 0) < 1 << 15 else "array<bigint>"
    equal = equal.withColumn("x", F.col("x").cast(narrow))
    c_blocks, q_blocks = -(-number["c"] // CANDIDATES) or 1, -(-(number["q"] or 0) // QUERIES) or 1
    block = lambda count, *salt: F.pmod(F.xxhash64("vec_id", "key", *salt), F.lit(count))
    each = equal.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    cand = each.withColumn("cb", block(c_blocks, "copy")).groupBy("n", "cb").agg(F.collect_list(F.struct("vec_id", "x")).alias("r"))
    cand = cand.select("n", "cb", F.col("r.vec_id").alias("c_ids"), F.col("r.x").alias("c_data"))
    query = equal.where("asked").withColumn("qb", block(q_blocks)).select("n", "qb", "vec_id", "key", "x")
    found = _met(query.withColumn("floor", F.lit(float("-inf"))), cand.where("cb = 0"), [0, 0], q_blocks, k)
    if c_blocks > 1:
        found = cut(found, "first-block")
        floors = found.groupBy(F.col("query_id").alias("vec_id"), F.col("q_key").alias("key")).agg(F.count("*").alias("c"), F.min("score").alias("floor"))
        floored = query.join(floors.where(F.col("c") == k).drop("c").hint("merge"), ["vec_id", "key"], "left")
        floored = floored.withColumn("floor", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))))
        found = found.union(_met(floored, cand.where("cb > 0"), [1, c_blocks - 1], (c_blocks - 1) * q_blocks, k))
    best = Window.partitionBy("query_id", "q_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
