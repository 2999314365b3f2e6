"""Source divergence audit: how far the sources of a language are apart in their words, and which words set a source apart from its language.

Terms are runs of letters (A-Z, a-z and everything beyond ASCII; A-Z lower-cased). A language keeps the terms of at least `least` of its documents. A group
is a (language, source). With its count c of a kept term, its sum N of counts and V kept terms, its smoothed share is p = 1 + floor(10**9 * (c + 5) / (N + 5 V)),
in whole numbers. Two groups differ by the sum over kept terms of |p - q|.

1. Tasks count terms and documents by language and source in dictionaries of a bounded size; Spark adds the counts.
2. Most terms of most sources have count 0, where a group's share is its z. The sum over all V terms of |z_i - z_j| is corrected where group i has the term,
   as if j had not: by sums over the shares of i below and above z_j, from running sums over them (a window with a row for each distinct share and each other
   source, so no pair of rows is formed). Where both have the term, one more correction is due.
3. That comes from a frequent-pattern tree. A term's row lists the groups that have it, the frequent ones first, with their counts. Equal rows are counted.
   Rows in path order are inserted into the trees of their portion: a node is a (group, count) below a path, its multiplicity the terms that pass through. Every
   node gives the correction of its group with the group of each ancestor once, times its multiplicity. Trees of different portions add up, as corrections are linear.
   A portion keeps one level of nodes as arrays, so memory is bounded whatever the number of terms.

Null languages, sources and texts are '' (a null text is a document without terms). Repeated rows are documents each. Groups without terms are groups, too. Equal
values rank by the item's UTF-8 bytes. An empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.llm.common import cut

#: Terms a task holds before it passes their counts on, so many at once; bytes of a text that are read at once; terms (rows) of one portion's trees.
HELD, AT_ONCE, BLOCK, ROWS = 500_000, 50_000, 1 << 20, 4096
#: Lower-cases A-Z and turns what no term holds into spaces.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PATH = "array<struct<rank:int,count:long,p:long,z:long>>"


def _terms(raw: bytes):
    """The terms of a text in blocks that cut no term."""
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + BLOCK)
        part = raw[lo:hi].translate(_TERM)
        while hi < len(raw) and not part.endswith(b" "):
            if (at := part.rfind(b" ")) >= 0:
                part, hi = part[: at + 1], lo + at + 1
            else:
                part, hi = part + raw[hi : hi + BLOCK].translate(_TERM), min(len(raw), hi + BLOCK)
        yield part.split()
        lo = hi


def _counted():
    """(lang, source, term, count, docs) of what a task has read, in portions; a group without terms has a row with term null."""
    from collections import Counter

    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]

    def told(held: dict):
        for group, terms in held.items():
            rows = iter((*terms.items(), (None, 0)))
            while some := list(islice(rows, AT_ONCE)):
                columns = [[group[0]] * len(some), [group[1]] * len(some), [t for t, _ in some], [n >> 40 for _, n in some], [n & (1 << 40) - 1 for _, n in some]]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                arrays[2] = arrays[2].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "count", "docs"])

    def run(batches):
        held: dict = {}  # by group and term: occurrences * 2**40 + documents
        size = 0
        for b in batches:
            langs, sources, texts = b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary())
            for i in range(b.num_rows):
                terms = held.setdefault((langs[i], sources[i]), {})
                own: Counter = Counter()
                for block in _terms(texts[i].as_py()):
                    own.update(block)
                size -= len(terms)
                for t, n in own.items():
                    terms[t] = terms.get(t, 0) + (n << 40 | 1)
                size += len(terms)
                if size > HELD:
                    yield from told(held)
                    held, size = {}, 0
        if held:
            yield from told(held)

    return run


class Level:
    """The nodes of one depth of a portion's trees: the row each starts at, and its multiplicity."""

    def __init__(self, starts: np.ndarray, times: np.ndarray) -> None:
        self.starts, self.times = starts, times


def tree(rank: np.ndarray, count: np.ndarray, size: np.ndarray, times: np.ndarray) -> list[Level]:
    """Levels of the tree of rows in path order. rank, count: rows x depth; size: lengths of the rows; times: their multiplicities.

    A row shares the nodes of the row before as far as their paths agree, and starts new ones below.
    """
    same = (rank[1:] == rank[:-1]) & (count[1:] == count[:-1])
    shared = np.append(0, np.logical_and.accumulate(same, axis=1).sum(1))
    shared = np.minimum(shared, size)
    out = []
    for depth in range(rank.shape[1]):
        cuts = np.flatnonzero(shared <= depth)
        sums = np.add.reduceat(times, cuts)
        there = size[cuts] > depth
        out.append(Level(cuts[there], sums[there]))
    return out


def corrections(rows: list[tuple[list[dict], int]]) -> dict[tuple[int, int], int]:
    """Sum over the tree's nodes and their ancestors, by ranks (ancestor, node), of what having the term both changes, times the node's multiplicity.

    rows: (path, multiplicity) of one language in path order; a path's elements have rank, count, p and z.
    """
    depth = max(len(p) for p, _ in rows)
    size = np.array([len(p) for p, _ in rows])
    field = {f: np.full((len(rows), depth), -1, np.int64) for f in ("rank", "count", "p", "z")}
    for f, x in field.items():
        x[np.arange(depth)[None, :] < size[:, None]] = [e[f] for p, _ in rows for e in p]
    rank, p, z = field["rank"], field["p"], field["z"]
    keys, values = [], []
    for k, level in enumerate(tree(rank, field["count"], size, np.array([t for _, t in rows], np.int64))):
        if not k or not level.starts.size:
            continue
        at = level.starts
        pk, zk, pj, zj = p[at, k, None], z[at, k, None], p[at, :k], z[at, :k]
        change = np.abs(pk - pj) - np.abs(pk - zj) - np.abs(zk - pj) + np.abs(zk - zj)
        keys.append(((rank[at, :k] << 32) | rank[at, k, None]).ravel())
        values.append((change * level.times[:, None]).ravel())
    if not keys:
        return {}
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return {(int(k) >> 32, int(k) & (1 << 32) - 1): int(v) for k, v in zip(key[first], np.add.reduceat(value, first))}


def _trees():
    """(lang, a, b, value): corrections of each portion of rows (lang, path, times) in path order."""

    def run(batches):
        from collections import defaultdict

        total: dict = defaultdict(int)
        for b in batches:
            langs, paths, times = (b.column(c).to_pylist() for c in ("lang", "path", "times"))
            lo = 0
            for i in range(1, len(langs) + 1):
                if i == len(langs) or langs[i] != langs[lo] or i - lo == ROWS:
                    for (x, y), v in corrections(list(zip(paths[lo:i], times[lo:i]))).items():
                        total[langs[lo], x, y] += v
                    lo = i
            if len(total) > HELD:
                yield from _told(total)
                total.clear()
        yield from _told(total)

    return run


def _told(total: dict):
    if total:
        columns = list(zip(*((*k, v) for k, v in total.items())))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["lang", "a", "b", "value"])


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (n + 5 v)), exactly."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", (wide(count) + F.lit(5)) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(n) + wide(v) * F.lit(5)) + 1


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs (written): occurrences and documents of each term of a group; term null once for every group."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    each = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counted(), "lang string, source string, term string, count long, docs long")
    return cut(each.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "terms")


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of every group of `docs` (lang, source, text).

    part 'pair': each other source of the language by distance. part 'term': the `top` kept terms whose share exceeds the language's by most.
    """
    found = counts(docs)
    terms = found.where("term IS NOT NULL")
    kept = cut(terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("in_lang")).where(F.col("docs") >= least).select("lang", "term", "in_lang"), "kept")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("n_lang"))
    rows = cut(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "in_lang"), "kept-counts")
    # groups: their sums, zero shares, and ranks, the group with most terms first
    groups = found.where("term IS NULL").select("lang", "source").join(of_lang, "lang", "left").join(rows.groupBy("lang", "source").agg(F.count("*").alias("has"), F.sum("count").alias("n")), ["lang", "source"], "left")
    groups = groups.na.fill(0, ["v", "n_lang", "has", "n"]).withColumn("z", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v"))).otherwise(0))
    groups = cut(groups.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("has"), "source"))), "groups")
    of_group = groups.select("lang", "source", "n", "v", "z", "rank", "n_lang")
    # groups are few beside the terms; Spark broadcasts their table where its size allows
    shares = rows.join(of_group, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("n"), F.col("v")))
    shares = cut(shares.withColumn("q", _share(F.col("in_lang"), F.col("n_lang"), F.col("v"))).select("lang", "source", "term", "count", "p", "q", "z", "rank"), "shares")
    return _pairs(shares, groups).unionByName(_top_terms(shares, top))


def _top_terms(shares: DataFrame, top: int) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ahead = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ahead.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    zeros = groups.select("lang", "source", "rank", "z", "v")
    other = lambda: zeros.select("lang", F.col("source").alias("item"), F.col("rank").alias("rank_j"), F.col("z").alias("z_j"))
    both = cut(zeros.join(other(), "lang").where(F.col("source") != F.col("item")), "group-pairs")  # the result's own rows
    # what having the term changes in i while j hasn't it: sum of |p - z_j| - |z - z_j| over the terms of i
    steps = shares.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count("*").alias("c")).withColumn("s", F.col("at") * F.col("c"))
    points = steps.select("lang", "source", "at", "c", "s", F.lit(None).cast("string").alias("item")).unionByName(
        both.select("lang", "source", F.col("z_j").alias("at"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("s"), "item")
    )
    whole, below = Window.partitionBy("lang", "source"), Window.partitionBy("lang", "source").orderBy("at")
    points = points.select("lang", "source", "item", "at", F.sum("c").over(whole).alias("cs"), F.sum("s").over(whole).alias("ss"), F.sum("c").over(below).alias("c"), F.sum("s").over(below).alias("s"))
    one = points.where("item IS NOT NULL").select("lang", "source", "item", "cs", (F.col("at") * (2 * F.col("c") - F.col("cs")) + F.col("ss") - 2 * F.col("s")).alias("sum"))
    one = both.join(one, ["lang", "source", "item"]).withColumn("apart", F.abs(F.col("z") - F.col("z_j")))
    one = cut(one.select("lang", "source", "item", "rank", "rank_j", "v", "apart", (F.col("sum") - F.col("cs") * F.col("apart")).alias("one")), "one-sided")
    back = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("one").alias("back"))
    # what having it both changes, from the trees
    path = F.array_sort(F.collect_list(F.struct(F.col("rank"), "count", "p", "z")))
    paths = shares.groupBy("lang", "term").agg(path.cast(_PATH).alias("path")).where(F.size("path") > 1).groupBy("lang", "path").agg(F.count("*").alias("times"))
    near = F.xxhash64("lang", F.slice("path", 1, 4))  # paths that begin alike meet in one portion
    sums = paths.repartition(near).sortWithinPartitions("lang", "path").mapInArrow(_trees(), "lang string, a int, b int, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("met"))
    out = one.join(back, ["lang", "source", "item"]).withColumn("a", F.least("rank", "rank_j")).withColumn("b", F.greatest("rank", "rank_j")).join(sums, ["lang", "a", "b"], "left")
    value = F.col("v") * F.col("apart") + F.col("one") + F.col("back") + F.coalesce("met", F.lit(0))
    out = out.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("v") > 0, value).otherwise(0).cast("long").alias("value"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
