"""Fingerprints of documents and what they find: exact copies, near copies."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.functions import text as X
from docwatch.session import settled


def fingerprints(df: DataFrame, body: str = "text", title: str | None = None, metadata: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """`df` with content_hash, normalized_hash and, where asked for, title_hash, metadata_hash (of a map, by sorted key) and structure_hash (of the names of `fields` that hold a value)."""
    out = df.withColumns({"content_hash": F.sha2(F.col(body).cast("binary"), 256), "normalized_hash": X.text_hash(F.col(body))})
    if title:
        out = out.withColumn("title_hash", F.when(F.col(title) != "", X.text_hash(F.col(title))))
    if metadata:
        out = out.withColumn("metadata_hash", F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col(metadata))))), 256))
    if fields:
        held = F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.lit(f)) for f in sorted(set(fields))]))
        out = out.withColumn("structure_hash", F.sha2(F.array_join(held, ","), 256))
    return out


#: Words whose bits a task holds at once.
WORDS = 100_000


def _bit_counts(ws):
    """For an Arrow array of lists of words how many of a list have each of the 64 bits, lowest first, in their hash: each different word is hashed once, bits are added up by pieces of `WORDS` words."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    size = np.array(ws.value_lengths().fill_null(0), np.int64)
    found = ws.flatten().dictionary_encode()
    known = found.dictionary.to_pylist()
    bits = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[8:] for w in known), np.uint8).reshape(-1, 8)
    bits = np.unpackbits(bits, axis=1)
    at, owner = np.asarray(found.indices), np.repeat(np.arange(len(size)), size)
    ones = np.zeros((len(size), 64), np.int64)
    for a in range(0, len(at), WORDS):
        mine = owner[a : a + WORDS]
        begin = np.flatnonzero(np.diff(mine, prepend=-1))
        ones[mine[begin]] += np.add.reduceat(bits[at[a : a + WORDS]], begin, axis=0, dtype=np.int32)
    return pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * 64, ones[:, ::-1].ravel())


def simhash64(df: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, simhash): bit b is set if more of the text's words (repeats count) have bit b in their hash than not; 0 without words.

    Words are hashed and their bits counted in the tasks, once a batch for each different word (a word's hash is as `text.word_hash` has it), so one row a text moves.
    """
    d = df.select(key, X.words(F.col(body)).alias("ws")).select(key, F.greatest(F.size("ws"), F.lit(0)).alias("n"), F.arrow_udf(_bit_counts, "array<long>")("ws").alias("ones"))
    sums = d.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(F.get("ones", F.lit(i))).alias(f"s{i}") for i in range(64)])
    return sums.select(key, F.coalesce(X.from_bits([F.col(f"s{i}") * 2 > F.col("n") for i in range(64)]), F.lit(0).cast("long")).alias("simhash"))


#: 64 bits in six blocks: fingerprints at distance 3 or less agree in three of them at least.
_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def near_duplicate_pairs(hashes: DataFrame, key: str = "doc_id", max_distance: int = 3) -> DataFrame:
    """Pairs of different fingerprints at most `max_distance` (3 at most) apart: doc_a, doc_b (the least keys with them), distance, copies_a, copies_b.

    Documents with one fingerprint are one class, so copies are never expanded into pairs. Every choice of three of six blocks of
    bits is a join key (20 of about 32 bits), which misses no pair and keeps groups small at any number of documents. Fingerprint 0 (no words) takes no part.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("max_distance must be 0 to 3")
    # both sides of the join read them
    classes = settled(hashes.where("simhash <> 0").groupBy("simhash").agg(F.min(key).alias("id"), F.count("*").alias("copies")))
    block = [F.shiftrightunsigned("simhash", s).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for s, w in _BLOCKS]
    keys = F.array(*[F.struct(F.lit(n).alias("n"), *[block[i].alias(f"b{j}") for j, i in enumerate(c)]) for n, c in enumerate(combinations(range(6), 3))])
    rows = classes.withColumn("k", F.explode(keys)).select("id", "simhash", "copies", "k.*")
    side = lambda x: rows.select("n", "b0", "b1", "b2", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "simhash", "copies")))
    near = X.distance(F.col("simhash_a"), F.col("simhash_b"))
    pairs = side("a").join(side("b"), ["n", "b0", "b1", "b2"]).where((F.col("id_a") < F.col("id_b")) & (near <= max_distance))
    return pairs.select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"), near.cast("int").alias("distance"), F.col("copies_a"), F.col("copies_b")).distinct()


def duplicate_of(df: DataFrame, key: str = "doc_id", body: str = "text", order: list[str] | None = None) -> DataFrame:
    """(key, normalized_hash, near_duplicate_of): the first document with the same normalized body, null for that one itself.

    First by `order` (the key alone by default). One aggregate and one join, so a group of copies may be of any size.
    """
    h = df.select(key, *[c for c in order or [] if c != key], X.text_hash(F.col(body)).alias("normalized_hash"))
    first = h.groupBy("normalized_hash").agg(F.min(F.struct(*(order or []), key)).alias("f")).select("normalized_hash", F.col(f"f.{key}").alias("first"))
    return h.join(first, "normalized_hash").select(key, "normalized_hash", F.when(F.col("first") != F.col(key), F.col("first")).alias("near_duplicate_of"))


def keep_oldest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`, of equal ones any. Keys travel as a hash, and each task sends on one row of a key, however many copies there are."""
    key = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    return df.groupBy(key.alias("k")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
