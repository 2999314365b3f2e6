"""N-gram Jaccard join in size-banded tiles, with hashed bitmap signatures before the exact intersection.

Finding every link (Jaccard of the distinct shingle sets >= percent/100), losslessly:

1. Two linked sets of a and b shingles differ in at most d = (1-t)/(1+t) * (a+b) shingles. Sizes
   are banded by factors of 1.4; in the tile of a band the shingles are dealt by hash into more
   chunks than the largest difference there, so linked sets agree in a whole filled chunk. A set
   enters its own band and, if a linked partner may be smaller than that band, the one below. A
   row (chunk fingerprint, class) goes out for each chunk: no pair is formed yet.
2. Exact copies share one class (the fingerprint of the whole set) from the start.
3. In each chunk group the least class is the leader; (leader, member) are the first
   candidates, a number linear in the rows. Groups that are very frequent in a sample are salted, their leaders taken from the salts' leaders. Bitmaps (1024 parity bits a set) bound the
   overlap from above by bit counts; survivors get the exact intersection of sorted arrays.
4. Components of these links. Where a chunk group still holds several components, the members outside the largest meet a
   few members of that (others in each group, so a link between two components is soon found). Where several
   are left after that, in groups of at most CROWD sets the pairs across components are tested. In crowded groups (a chunk
   of one shingle that many texts share) a set that has enough chunks in other groups meets each partner there. The others are keyed
   anew, so that candidates stay linear in the rows: a small set by its subsets that a link may leave in common (of the sets that
   hold such a subset the one with fewest other shingles links with all whose common part it is, so a leader is enough); a larger set by its rarest shingles (rare in a bounded sample of these sets; any order would do), of which
   linked sets share one, and where that is crowded, too, by two, three and four of them, as long as these chains are fewer than the pairs they save; pairs across
   components are tested only in what is left.
   Pairs within one component can't change the result, so components are exact while copies are never expanded into all pairs.

Nulls and empty texts have an empty set and link with nothing. Repeated rows each get a row. Extra columns
are ignored (of the result the columns are fixed). Rows of the same doc_id are told apart by text.
"""

from __future__ import annotations

import bisect
import math
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.llm.common import components, cut, fresh, if_small, merged
from docwatch.llm.shingles import U, column_bytes, mix, text_shingles

BITS = 1024
#: Rounds of bridging between components before the last, exhaustive one.
BRIDGES, HOSTS = 1, 8
#: Sets in a chunk group from which on it counts as crowded.
CROWD = 64
#: Subset keys of a small set at most; shingles that a chain of rare shingles has at most, and chains of one set at most.
SUBSETS, CHAIN, CHAINS = 300, 4, 2000
#: Thin sets in which frequent shingles are looked for, and the most frequent ones that are sent to the tasks at most. This changes the order of shingles only, not what is found.
SEEN, FREQUENT = 500, 100_000
#: One text in so many is looked at to find frequent chunk groups, of which so many at most are salted so many ways. This changes the plan only.
LOOK, HOT, SALTS = 64, 1000, 64


def _class_of(s: np.ndarray) -> int:
    return int(np.append(mix(s ^ U(0x5851F42D4C957F2D)), mix(np.array([s.size + 7], U))).sum(dtype=U).astype(np.int64))


def _bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((s >> U(54)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


@lru_cache(None)
def _starts() -> tuple[int, ...]:
    """First sizes of the bands, each about 1.4 times the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * 1.4)))
    return tuple(out)


@lru_cache(None)
def tile(band: int, percent: int) -> tuple[int, int]:
    """(largest difference d, number of chunks k) in the tile of a band.

    The smaller set of a linked pair of this tile has low..high shingles, the larger at most
    high*100/percent. k exceeds d by enough that a set of `low` shingles nearly always fills more than d chunks.
    """
    low, high = _starts()[band], _starts()[band + 1] - 1
    d = (100 - percent) * (high + high * 100 // percent) // (100 + percent)
    k = d + 1
    while d and k < 3 * d + 3:
        empty = (1 - 1 / k) ** low
        spread = math.sqrt(k * empty * max(0.0, 1 - (1 + low / k) * empty))
        if k * (1 - empty) - 3 * spread >= d + 1:
            break
        k += 1
    return d, k


def tiles_of(n: int, percent: int) -> list[int]:
    """Bands whose tiles a set of n shingles enters: its own, and those below that may hold a linked smaller set."""
    band = bisect.bisect_right(_starts(), n) - 1
    out = [band]
    while out[-1] > 0 and n * percent <= (_starts()[out[-1]] - 1) * 100:
        out.append(out[-1] - 1)
    return out


def _chunk_rows(s: np.ndarray, percent: int) -> np.ndarray:
    """Fingerprints of the chunks of a set in all its tiles.

    Linked sets disagree in at most d of k chunks. A set that fills more than d chunks hence shares a filled
    one with every partner; a set that fills fewer sends its empty chunks too, marked, for those of its kind.
    """
    rows = []
    spread = mix(s + U(0x1B873593)) >> U(32)
    value = mix(s ^ U(0xC2B2AE3D27D4EB4F))
    for band in tiles_of(s.size, percent):
        d, k = tile(band, percent)
        where = (spread * U(k) >> U(32)).astype(np.int64)
        sums = np.zeros(k, U)
        np.add.at(sums, where, value)
        filled = np.bincount(where, minlength=k) > 0
        names = mix(sums ^ mix((np.arange(k, dtype=np.uint64) << U(8)) + U(band + 1)))
        names[~filled] = ~names[~filled]
        if filled.sum() > d:
            names = names[filled]
        rows.append(names << U(6) | U(band))
    return np.concatenate(rows)


def _spare(s: np.ndarray, percent: int) -> list[int]:
    """For each tile band * 2**32 + filled chunks - d: how many filled chunks more than a linked partner can spoil."""
    spread = mix(s + U(0x1B873593)) >> U(32)
    out = []
    for band in tiles_of(s.size, percent):
        d, k = tile(band, percent)
        filled = np.count_nonzero(np.bincount((spread * U(k) >> U(32)).astype(np.int64), minlength=k))
        out.append((band << 32) + max(0, filled - d))
    return out


def _common(n: int, percent: int) -> int:
    """Shingles that a set of n shares with a linked one at least."""
    return -(-n * percent // 100)


@lru_cache(None)
def small_sizes(percent: int) -> tuple[int, int]:
    """(largest size of a small set, largest size of a set linked with one): what both sides key by subsets."""
    out = (0, 0)
    for n in range(1, 65):
        top = n * 100 // percent
        if sum(math.comb(top, r) for r in range(top - _common(top, percent) + 1)) > SUBSETS:
            break
        out = (n, top)
    return out


def _subset_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """A fingerprint of each subset that a linked set may have in common with this one."""
    value = mix(s ^ U(0x94D049BB133111EB))
    whole, keys = value.sum(dtype=U), []
    for r in range(s.size - _common(s.size, percent) + 1):
        gone = np.array(list(combinations(range(s.size), r)), np.int64).reshape(math.comb(s.size, r), r)
        keys.append(mix(whole - value[gone].sum(1, dtype=U) + U(s.size - r)))
    return np.concatenate(keys)


def _subsets(percent: int):
    def run(batches):
        for b in batches:
            for c, arr in zip(b.column("cls"), b.column("arr")):
                keys = _subset_keys(np.asarray(arr.values).view(U), percent).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(keys.size, c.as_py()))], ["key", "cls"])

    return lambda batches: _merged(run(batches))


def _rare(percent: int, frequent: np.ndarray, times: np.ndarray):
    """cls, p, e: for each set its rarest shingles, p of which one is in common with every linked set, and CHAIN - 1 more.

    Rarer is what is not among the `frequent` ones (sorted) or has fewer `times` there, then the smaller hash: one order for all sets.
    """

    def run(batches):
        for b in batches:
            p, e = [], []
            for arr in b.column("arr"):
                s = np.asarray(arr.values)
                at = np.minimum(np.searchsorted(frequent, s), max(0, frequent.size - 1))
                f = np.where(frequent[at] == s, times[at], 0) if frequent.size else np.zeros(s.size, np.int64)
                p.append(s.size - _common(s.size, percent) + 1)
                e.append(s[np.lexsort((s, f))[: p[-1] + CHAIN - 1]])
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(p, pa.int32()), pa.array(e, pa.list_(pa.int64()))], ["cls", "p", "e"])

    return run


def _profile(width: int, percent: int):
    def run(batches):
        for b in batches:
            sets = list(text_shingles(column_bytes(b.column("text")), width))
            if sets:
                ends = pa.array(np.arange(0, 16 * len(sets) + 1, 16), pa.int32())
                spare = pa.array([_spare(s, percent) if s.size else [] for s in sets], pa.list_(pa.int64()))
                columns = [pa.array([s.size for s in sets], pa.int64()), pa.array([_class_of(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([_bitmap(s) for s in sets]))), spare]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), *columns], ["doc_id", "tkey", "n", "cls", "bits", "spare"])

    return run


def _tiles(width: int, percent: int):
    def run(batches):
        seen: set[int] = set()  # classes this task has sent already, so that exact copies go out once a task
        for b in batches:
            for s in text_shingles(column_bytes(b.column("text")), width):
                if not s.size or (c := _class_of(s)) in seen:
                    continue
                seen.add(c)
                rows = _chunk_rows(s, percent).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(rows.size, c))], ["sig", "cls"])

    return lambda batches: _merged(run(batches))


def _merged(batches, least: int = 50_000):
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _arrays(width: int):
    def run(batches):
        for b in batches:
            for i, s in enumerate(text_shingles(column_bytes(b.column("text")), width)):
                if _class_of(s) == b.column("cls")[i].as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([_class_of(s)], pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["cls", "arr"])

    return lambda batches: _merged(run(batches), 500)


def _linked(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for i in range(b.num_rows):
                x, y = (np.asarray(b.column(c)[i].values).view(U) for c in ("arr_a", "arr_b"))
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (x.size + y.size - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _possible(percent: int):
    """Bit counts bound the overlap from above: |A and B| <= (|A| + |B| - hamming) / 2, and it is at most the smaller size."""
    apart = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    sizes = F.col("n_a") + F.col("n_b")
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return near & (F.shiftright(sizes - apart, 1) * (100 + percent) >= sizes * percent)


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Component of every row of `docs` (doc_id, text): doc_id, tkey, n_shingles, component_id, label.

    `tkey` is the hash of the text (of rows that share a doc_id, it tells them apart); component_id the
    least doc_id of the component (null only if all its doc_ids are null). `label` tells components apart even
    if doc_ids repeat; it is null for texts without words.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.withColumn("tkey", F.xxhash64(F.coalesce("text", F.lit(""))))
    profile = cut(keyed.mapInArrow(_profile(width, percent), "doc_id long, tkey long, n long, cls long, bits array<long>, spare array<long>"), "profile")
    reps = profile.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "tkey")).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("spare").alias("spare"))
    reps = cut(reps.select("cls", "least_id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tkey").alias("rep_key"), "n", "bits", "spare"), "reps")

    tiles = lambda d: d.select("text").mapInArrow(_tiles(width, percent), "sig long, cls long")
    seen = tiles(docs.where(F.pmod(F.xxhash64("text"), F.lit(LOOK)) == 0)).distinct().groupBy("sig").agg(F.count("*").alias("c")).where(F.col("c") >= CROWD)
    hot = cut(seen.orderBy(F.desc("c"), "sig").limit(HOT).select("sig", F.lit(True).alias("hot")), "hot")
    dealt = tiles(docs).join(F.broadcast(hot), "sig", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    by_sig = Window.partitionBy("sig", F.when(F.col("hot"), F.pmod(F.xxhash64("cls"), F.lit(SALTS))).otherwise(0))
    dealt = dealt.select("sig", "cls", "hot", F.min("cls").over(by_sig).alias("lead"), F.max("cls").over(by_sig).alias("last")).where("hot OR lead <> last")
    dealt = cut(dealt.select("sig", "cls", "hot", "lead").distinct(), "dealt")
    leads = dealt.where("hot").groupBy("sig").agg(F.min("cls").alias("lead"), F.max("cls").alias("last")).where("lead <> last").select("sig", "lead")
    members = dealt.where("NOT hot").select("sig", "cls", "lead").union(dealt.where("hot").select("sig", "cls").join(F.broadcast(leads), "sig"))

    known: list[DataFrame] = []  # arrays of the classes met so far

    def arrays_of(wanted: DataFrame, name: str) -> DataFrame:
        """(cls, arr) of the classes met so far and of those `wanted` (distinct)."""
        for k in known:
            wanted = wanted.join(k.select("cls"), "cls", "left_anti")
        wanted = if_small(cut(wanted.join(reps.select("cls", "rep_id", "rep_key"), "cls"), f"{name}-wanted"))
        texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("tkey") == F.col("rep_key"))).select("cls", "text")
        arrays = texts.mapInArrow(_arrays(width), "cls long, arr array<long>").groupBy("cls").agg(F.first("arr").alias("arr"))
        known.append(cut(arrays, f"{name}-arrays"))
        return reduce(DataFrame.union, known)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        info = reps.select("cls", "n", "bits")
        of = lambda x: info.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
        live = cut(pairs.join(of("a"), "a").join(of("b"), "b").where(_possible(percent)).select("a", "b"), f"{name}-candidates")
        every = arrays_of(live.select(F.col("a").alias("cls")).union(live.select(F.col("b").alias("cls"))).distinct(), name)
        full = live.join(every.select(F.col("cls").alias("b"), F.col("arr").alias("arr_b")), "b").join(every.select(F.col("cls").alias("a"), F.col("arr").alias("arr_a")), "a")
        return cut(full.select("a", "b", "arr_a", "arr_b").mapInArrow(_linked(percent), "a long, b long"), f"{name}-links")

    def still_open(labels: DataFrame, name: str) -> DataFrame:
        labelled = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        mixed = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
        return cut(labelled.join(mixed, "sig").select("sig", "cls", "lead", "label"), name)

    first = members.where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    tried, links = cut(first, "first"), verified(first, "first")
    labels = cut(components(links), "labels")
    rest = still_open(labels, "open")
    sized = reps.select("cls", "n", "bits")
    for turn in range(BRIDGES):
        # the members of each group outside its largest component meet some members of that, others in each group
        rows = rest.join(sized, "cls")
        largest = rest.groupBy("sig", "label").agg(F.count("*").alias("c")).groupBy("sig").agg(F.max(F.struct("c", -F.col("label"))).alias("m")).select("sig", (-F.col("m.col2")).alias("main"))
        rows = rows.join(largest, "sig")
        nth = Window.partitionBy("sig").orderBy(F.xxhash64("cls", "sig", F.lit(turn)))
        hosts = rows.where("label = main").withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= HOSTS)
        hosts = hosts.select("sig", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
        guests = rows.where("label <> main").select("sig", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
        met = hosts.join(guests, (hosts["sig"] == guests["sig"]) & _possible(percent))
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        met = cut(met.join(tried, ["a", "b"], "left_anti"), "bridges")
        found = verified(met, "bridge")
        if not found.take(1):
            break
        tried, labels = tried.union(met), merged(labels, found)
        rest = still_open(labels, "open")
    # In a group of many sets only those count that have few chunks elsewhere: a set with more than d filled chunks
    # in other groups shares one of these with each partner, and meets it there.
    crowded = rest.groupBy("sig").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("sig")
    band = F.col("sig").bitwiseAND(F.lit(63).cast("long"))
    in_crowd = rest.join(crowded, "sig").withColumn("band", band)
    spare = reps.select("cls", F.explode("spare").alias("s")).select("cls", F.shiftright("s", 32).alias("band"), F.col("s").bitwiseAND(F.lit((1 << 32) - 1)).alias("s"))
    thin = in_crowd.groupBy("cls", "band").agg(F.count("*").alias("c")).join(spare, ["cls", "band"]).where("c >= s").select("cls", "band")
    thin_rows = cut(in_crowd.join(thin, ["cls", "band"]).select(*rest.columns), "thin-rows")
    thin = cut(thin_rows.select("cls").distinct(), "thin")
    groups = rest.join(crowded, "sig", "left_anti").select(F.col("sig").alias("key"), "cls")
    more = []
    if thin.take(1):
        every = cut(arrays_of(thin, "thin").join(thin, "cls").withColumn("size", F.size("arr")), "thin-sets")
        small, top = small_sizes(percent)
        deepest = min(CHAIN, _common(small + 1, percent))  # linked larger sets share so many shingles at least
        keys = cut(every.where(F.col("size") <= top).select("cls", "arr").mapInArrow(_subsets(percent), "key long, cls long").join(sized.select("cls", "n"), "cls"), "subsets")
        leads = keys.groupBy("key").agg(F.min(F.struct("n", "cls")).alias("lead"), F.count("*").alias("c")).where("c > 1").select("key", F.col("lead.cls").alias("lead"))
        met = keys.join(leads, "key").where("cls <> lead")
        more.append(met.select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")))
        rows = every.where(F.col("size") > small)
        seen = rows.select("cls", "arr").orderBy(F.xxhash64("cls"), "cls").limit(SEEN).select(F.explode("arr").alias("s"))
        often = seen.groupBy("s").agg(F.count("*").alias("f")).where("f > 1").orderBy(F.desc("f"), "s").limit(FREQUENT).toArrow()
        order = np.argsort(often["s"].to_numpy(), kind="stable")
        rare = rows.select("cls", "arr").mapInArrow(_rare(percent, often["s"].to_numpy()[order], often["f"].to_numpy()[order]), "cls long, p int, e array<long>")
        chain = rare.select("cls", "p", "e", F.posexplode(F.slice("e", F.lit(1), F.col("p"))).alias("at", "key"))
        for depth in range(1, deepest + 1):
            chain = cut(chain, "chain")
            # longer chains where they are fewer than the pairs, and not too many for the largest set; one answer for all sets of a group
            most = F.lit(1.0)
            for i in range(depth + 1):
                most = most * (F.col("p") + depth - i) / (i + 1)
            full = chain.groupBy("key").agg(F.count("*").alias("c"), F.max("p").alias("p")).where((F.col("c") > CROWD) & (8 * F.col("p") <= F.col("c")) & (most <= CHAINS))
            full = cut(full.select("key"), "full")
            if depth == deepest or not full.take(1):
                groups = groups.union(chain.select("key", "cls"))
                break
            full = if_small(full)
            groups = groups.union(chain.join(full, "key", "left_anti").select("key", "cls"))
            chain = chain.join(full, "key", "left_semi").select("cls", "p", "e", "key", "at", F.posexplode("e").alias("next", "s"))
            chain = chain.where((F.col("next") > F.col("at")) & (F.col("next") < F.col("p") + depth))
            chain = chain.select("cls", "p", "e", F.col("next").alias("at"), F.xxhash64("key", "s").alias("key"))
    # pairs of different components in one group; the bitmaps must allow a link
    groups = groups.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")).join(sized, "cls")
    side = lambda x: groups.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("cls", "label", "n", "bits")))
    a, b = side("a"), side("b")
    met = a.join(b, (a["key"] == b["key"]) & (F.col("cls_a") < F.col("cls_b")) & (F.col("label_a") != F.col("label_b")) & _possible(percent))
    more.append(met.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")))
    more = cut(reduce(DataFrame.union, more).distinct().join(tried, ["a", "b"], "left_anti"), "more")
    if more.take(1):
        extra = verified(more, "second")
        if extra.take(1):
            labels = merged(labels, extra)

    classed = reps.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = classed.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = classed.join(least, "label").select("cls", "component_id", "label")
    linked = profile.join(of_class, "cls", "left")
    alone = F.col("n") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return linked.select("doc_id", "tkey", F.col("n").alias("n_shingles"), component.alias("component_id"), "label")


def dedupe(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component: the one of least doc_id (of equal ids, of least text hash), its columns unchanged.

    Documents without words stay. Rows with the same doc_id and text are one document. A null doc_id stays only
    where the whole component has none.
    """
    found = classes(docs, width, percent)
    key = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("tkey"))
    kept = found.where("n_shingles > 0").groupBy("label").agg(F.min(key).alias("k"))
    kept_id, kept_key, text_key, nth = fresh(docs, "kept_id", "kept_key", "text_key", "nth")
    kept = kept.select(F.col("k.doc_id").alias(kept_id), F.col("k.tkey").alias(kept_key)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.withColumn(text_key, F.xxhash64(text))
    rank = Window.partitionBy("doc_id", text_key).orderBy(F.lit(0))
    has_words = text.rlike("[^\\x20\\x09-\\x0D]")
    joined = one.where(has_words).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(text_key) == F.col(kept_key)))
    joined = joined.withColumn(nth, F.row_number().over(rank)).where(F.col(nth) == 1)
    return joined.select(*docs.columns).unionByName(one.where(~has_words).select(*docs.columns))
