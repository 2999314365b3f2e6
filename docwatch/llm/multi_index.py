"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by its own k-means centroids; a row's cell is the pair of its centroids. A query takes
the pairs in the order of their summed squared distance, from a heap over the two sorted lists of centroid distances, until the cells hold the share of all rows
that `train` found to be enough. Their rows are reranked by the exact distance on the original vectors.

Bounds. The centroids are learned on the driver from SAMPLE rows at most, drawn by a hash; every row is indexed. Their number grows with the square root of
the rows, up to CENTROIDS a half. The share to visit is measured there, too: it is the one at which ASKED sampled queries find TARGET of their true neighbours
among the sampled rows. (Among all rows the true neighbours are nearer, so recall is no lower there.) The numbers of rows by cell, at most CENTROIDS ** 2, come to the driver.

Plan. Rows in the order of cells are dealt into zones of about ZONE rows; a cell with more is split by a hash of the row. A query goes to a zone once, with the list of
the cells that it visits there. Queries of a zone are taken in blocks, too, so tiles have a bounded size. Each tile returns k rows a query at most and a window ranks them.
The join of both is a shuffled one; of what grows with the rows nothing passes through the driver but the counts by cell, as an Arrow table.
Of equal vectors the 2 k rows of least ids (k of each id) are indexed: no query can have more of them among its k best.

Vectors that are null or empty, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors of
different lengths are not compared: each length has an index of its own. Equal rows (of id and vector) are one query but each a candidate;
rows with the query's id are never its candidates. Ties go to the smaller id. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.llm.common import cut

#: Rows that the quantisers are learned from; centroids a half; rounds of k-means; sampled queries, and the recall wanted among the sampled rows.
SAMPLE, CENTROIDS, ROUNDS, ASKED, TARGET = 20_000, 512, 12, 300, 0.975
#: Rows at least that a query visits (times k); rows of a zone; queries of a tile; lengths of vectors in one table; tasks that traverse cells, of 32 queries or more.
FEWEST, ZONE, QUERIES, LENGTHS, TASKS = 20, 4096, 4096, 100, 20_000


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0)


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k-means of the rows of x, from evenly spaced rows in their given (hashed) order; a centroid without rows stays where it is."""
    c = x[np.linspace(0, len(x) - 1, k).astype(np.int64)].copy()
    for _ in range(ROUNDS):
        near = _apart(x, c).argmin(1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        c[full] = np.add.reduceat(x[order], (np.cumsum(count) - count)[full]) / count[full, None]
    return c


class Index:
    """The two sets of centroids and the share of the rows to visit."""

    def __init__(self, first: np.ndarray, second: np.ndarray, share: float) -> None:
        self.first, self.second, self.share = first, second, share

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _apart(x[:, :half], self.first), _apart(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visit(self, a: np.ndarray, b: np.ndarray, rows: np.ndarray, need: int) -> list[int]:
        """Cells with rows, nearest first, until they hold `need` rows. a, b: the query's distances to the centroids; rows: the rows of each cell."""
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        da, db, ia, ib = a[by_a].tolist(), b[by_b].tolist(), by_a.tolist(), by_b.tolist()
        wide, found, out = len(ib), 0, []
        heap = [(da[0] + db[0], 0, 0)]
        while heap and found < need:
            _, i, j = heapq.heappop(heap)
            cell = ia[i] * wide + ib[j]
            if rows[cell]:
                out.append(cell)
                found += rows[cell]
            if j + 1 < wide:
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if not j and i + 1 < len(ia):  # each pair is pushed once: along j, and along i from the first column
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        return out


def train(sample: np.ndarray, rows: int, k: int = 10) -> Index:
    """Quantisers of a sample (in hashed order) of a table of `rows` rows, with the share of rows to visit for TARGET recall of k neighbours."""
    many = max(1, min(CENTROIDS, len(sample), math.isqrt(max(1, rows // 4))))
    half = sample.shape[1] // 2
    index = Index(centroids(sample[:, :half], many), centroids(sample[:, half:], many), 1.0)
    asked = sample[:: max(1, len(sample) // ASKED)][:ASKED]
    cell_a, cell_b = (d.argmin(1) for d in index.distances(sample))
    found = []
    for n, q in enumerate(asked):
        own = n * max(1, len(sample) // ASKED)
        exact = ((sample - q) ** 2).sum(1)
        exact[own] = np.inf
        best = np.argsort(exact, kind="stable")[: min(k, len(sample) - 1)]
        a, b = index.distances(q[None])
        order = a[0, cell_a] + b[0, cell_b]
        found.append([(order <= order[x]).mean() for x in best])
    shares = np.sort(np.concatenate(found)) if found else np.empty(0)
    if shares.size:
        index.share = float(shares[min(shares.size - 1, math.ceil(TARGET * shares.size))])
    return index


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _assign(index: Index):
    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"))
            cells = [index.cells(x[lo : lo + 4096]) for lo in range(0, len(x), 4096)]
            yield b.append_column("cell", pa.array(np.concatenate(cells or [np.empty(0, np.int64)]).astype(np.int32)))

    return run


def _visits(index: Index, rows: np.ndarray, need: int, zones: np.ndarray, parts: np.ndarray):
    """For every query a row for each zone that it visits, with its cells there."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"))
            for i in range(b.num_rows):
                a, c = index.distances(x[i : i + 1])
                cells = np.array(index.visit(a[0], c[0], rows, need), np.int64)
                at = np.repeat(cells, parts[cells])
                zone = zones[at] + np.arange(at.size) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
                order = np.argsort(zone, kind="stable")
                zone, at = zone[order], at[order]
                starts = np.flatnonzero(np.append(True, zone[1:] != zone[:-1])) if zone.size else np.empty(0, np.int64)
                many = pa.array(np.full(starts.size, i))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, zone.size), pa.int32()), pa.array(at.astype(np.int32)))
                columns = [pa.array(zone[starts]), *(b.column(n).take(many) for n in ("vec_id", "key", "x")), lists]
                yield pa.RecordBatch.from_arrays(columns, ["zone", "vec_id", "key", "x", "cells"])

    return run


def nearest_of_tile(q_ids: np.ndarray, q: np.ndarray, visited: list[np.ndarray], c_ids: np.ndarray, c: np.ndarray, cells: np.ndarray, k: int):
    """(query row, candidate id, distance) of the k nearest rows of the visited cells for each query of the tile."""
    out = []
    for lo in range(0, len(q), 512):
        some = slice(lo, lo + 512)
        near = _apart(q[some], c)
        # what rounding may add to or take from a distance
        slack = 1e-9 * (1 + (q[some] ** 2).sum(1) + (c * c).sum(1).max(initial=0))
        for n, at in enumerate(visited[some]):
            i = lo + n
            live = np.flatnonzero(np.isin(cells, at) & (c_ids != q_ids[i]))
            if live.size > k:
                d = near[n, live]
                live = live[d <= np.partition(d, k - 1)[k - 1] + slack[n]]
            exact = np.sqrt(((c[live] - q[i]) ** 2).sum(1))
            best = np.lexsort((c_ids[live], exact))[:k]
            out.append((np.full(best.size, i), c_ids[live[best]], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _tiles(k: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                own = lambda n, i=i: b.column(n)[i].values
                q_ids, keys = np.asarray(own("q_ids")), np.asarray(own("q_keys"))
                visited = [np.asarray(x.values) for x in own("q_cells")]
                row, ids, apart = nearest_of_tile(q_ids, _matrix(own("q_data")), visited, np.asarray(own("c_ids")), _matrix(own("c_data")), np.asarray(own("c_cells")), k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(keys[row]), pa.array(ids), pa.array(apart)], ["query_id", "q_key", "vec_id", "score"])

    return run


def _of_length(v: DataFrame, k: int) -> DataFrame:
    """query_id, q_key, vec_id, score: the k nearest in every tile, of vectors of one length (vec_id, x, key, copies, asked; a written table)."""
    spark = v.sparkSession
    by_vector = Window.partitionBy("key", "x").orderBy("vec_id")
    kept = v.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumn("nth", F.row_number().over(by_vector)).where(F.col("nth") <= 2 * k)
    order = F.xxhash64("key", "vec_id")
    rows = v.count()
    drawn = v.select("x", order.alias("o"), "vec_id").orderBy("o", "vec_id").limit(SAMPLE).select("x").toArrow()
    index = train(_matrix(drawn["x"].combine_chunks()), rows, k)
    cells = cut(kept.select("vec_id", "x", "key", "copy").mapInArrow(_assign(index), "vec_id long, x array<double>, key long, copy int, cell int"), "multi-index")
    many = len(index.first) * len(index.second)
    count = np.zeros(many, np.int64)
    counted = cells.groupBy("cell").count().toArrow()
    count[np.asarray(counted["cell"].combine_chunks())] = np.asarray(counted["count"].combine_chunks())
    # zones in the order of cells; a large cell has several of its own
    parts = np.maximum(1, -(-count // ZONE))
    small = np.where(parts == 1, count, 0)
    start = np.cumsum(small) - small
    zones = start // ZONE + np.append(0, np.cumsum(np.where(parts > 1, parts, 0))[:-1])
    step = np.append(False, (parts[1:] > 1) | (parts[:-1] > 1))  # neither side of a split cell shares its zones
    zones = zones + np.cumsum(step)
    need = max(FEWEST * k, math.ceil(index.share * int(count.sum())))
    place = spark.createDataFrame(pa.table({"cell": pa.array(np.arange(many), pa.int32()), "first": zones, "parts": parts}).filter(pa.array(count > 0)))
    cand = cells.join(F.broadcast(place), "cell").withColumn("zone", F.col("first") + F.pmod(F.xxhash64("vec_id", "key", "copy"), "parts"))
    cand = cand.groupBy("zone").agg(F.collect_list(F.struct("vec_id", "x", "cell")).alias("r"))
    cand = cand.select("zone", F.col("r.vec_id").alias("c_ids"), F.col("r.x").alias("c_data"), F.col("r.cell").alias("c_cells"))
    asked = v.where("asked").count()
    query = v.where("asked").select("vec_id", "key", "x").repartition(max(1, min(TASKS, asked // 32)), order)
    query = query.mapInArrow(_visits(index, count, need, zones, parts), "zone long, vec_id long, key long, x array<double>, cells array<int>")
    blocks = -(-asked // QUERIES) or 1
    query = query.groupBy("zone", F.pmod(order, F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "key", "x", "cells")).alias("r"))
    query = query.select("zone", "block", F.col("r.vec_id").alias("q_ids"), F.col("r.key").alias("q_keys"), F.col("r.x").alias("q_data"), F.col("r.cells").alias("q_cells"))
    # sizes of arrays are guessed far too low, so a join by these guesses may send all rows through the driver
    met = query.join(cand.hint("merge"), "zone").repartition("zone", "block")
    return met.select("q_ids", "q_keys", "q_data", "q_cells", "c_ids", "c_data", "c_cells").mapInArrow(_tiles(k), "query_id long, q_key long, vec_id long, score double")


def search(vectors: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found in `vectors` (vec_id, embedding) for each row where `asked` holds."""
    v = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.coalesce(asked, F.lit(False)).alias("asked"))
    v = v.groupBy("vec_id", "x").agg(F.least(F.count("*"), F.lit(k)).alias("copies"), F.max("asked").alias("asked"))
    v = cut(v.withColumn("key", F.xxhash64("x")).withColumn("n", F.size("x")), "vectors")
    lengths = [r["n"] for r in v.select("n").distinct().orderBy("n").limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    out = v.sparkSession.createDataFrame([], "query_id long, q_key long, vec_id long, score double")
    for n in lengths:
        out = out.unionByName(_of_length(v.where(F.col("n") == n), k))
    best = Window.partitionBy("query_id", "q_key").orderBy("score", "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
