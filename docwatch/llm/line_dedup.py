"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

A document is the sequence of the IDs of its lines, a suffix is a position in it. Two positions with the
same name at level k start the same 2**k lines. Level 0 names are the lines; the name at level k+1 is made of the names at
level k of a position and of the one 2**k lines on. Each level is one aggregate over the names (combined
before the shuffle), and only names that occur twice go on: the rest of the corpus leaves after the first level.
The positions of one name are an interval of the suffix array (they share a prefix of that length); names take the place of ranks, because
only which suffixes share a prefix matters here and not the order of the intervals, so no total order of all suffixes is ever sorted.

The longest common prefix with an earlier position is then found exactly: from the highest level at which a position has an
earlier partner, its interval is narrowed by the names of the next lower levels, each narrowing one aggregate,
so after the last one every position knows the longest run that starts there and occurs earlier. Of the members of an interval that share a longer
stretch than it can still be narrowed to, all but the first go: they would meet the same names at each step, and only the first is asked for. An interval enters
with the level it starts from. Runs that no longer run contains are the maximal repeated runs. A run of at least `min_words` words is deleted where it is a
later copy; the first copy in order of (doc_id, hash of the text, line) stays. A later copy may overlap the earlier one.

Two prunings lose nothing. Of documents with the same text only the first enters: all others are one run, whole. And a
stretch of neighbouring lines that each occur elsewhere, but hold too few letters for `min_words` words, holds no run
and is part of no other's earlier copy. A name of very many positions never meets in one task: what is known of a name is sent to all tasks where
there are few names, else what is known of names of very many positions is, and the rest joined by name.

Null and empty texts have no line. Lines are compared exactly, blank lines count as lines of a run. Rows with the same
doc_id and text are one document and get the same result. A null doc_id comes first. Extra columns stay, whatever their names. Names are 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.llm.common import cut, drop, fresh, scope

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
#: Names up to this number are sent to all tasks (they are counted first); of more only those of more than HOT positions are.
FEW, HOT = 100_000, 10_000
AT = ["doc_id", "tkey", "i"]


def _place(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}doc_id"), F.col(f"{prefix}tkey"), F.col(f"{prefix}i"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc_id")) & (F.col(f"{a}tkey") == F.col(f"{b}tkey"))


def _told(rows: DataFrame, names: DataFrame, few: int, how: str = "inner") -> DataFrame:
    """`rows` joined with what `names` (one row each; c, if there, is how many positions have it) knows of their name; `how` is inner, or left if c is there."""
    names = cut(names, "names")
    told = names.drop("c")
    if names.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(told), "name", how)
    counts = names if "c" in names.columns else rows.groupBy("name").agg(F.count("*").alias("c"))
    hot = cut(counts.where(F.col("c") > HOT).select("name"), "hot")  # one name in HOT rows at most
    if not hot.take(1):
        return rows.join(told, "name", how)
    rest = rows.join(F.broadcast(hot), "name", "left_anti").join(told, "name", how)
    return rest.unionByName(rows.join(F.broadcast(told.join(F.broadcast(hot), "name")), "name"))


def _repeated(named: DataFrame, few: int) -> DataFrame:
    """Rows of `named` whose name occurs at two positions at least, with the first of these."""
    groups = named.groupBy("name").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"), F.count("*").alias("c")).where("first <> last").drop("last")
    return _told(named, groups, few)


def _documents(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    return d.withColumn("tkey", F.xxhash64("text"))


def later_copies(docs: DataFrame) -> DataFrame:
    """doc_id, tkey of the documents whose text an earlier document has."""
    keys = _documents(docs).select("doc_id", "tkey").distinct()
    first = keys.groupBy("tkey").agg(F.min(F.struct("doc_id")).alias("f"), F.max(F.struct("doc_id")).alias("z")).where("f <> z")
    return keys.join(first.select("tkey", "f"), "tkey").where(F.struct("doc_id") > F.col("f")).select("doc_id", "tkey")


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, i (from 0), name, letters of every line."""
    lines = _documents(docs).select("doc_id", "tkey", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select(*AT, F.xxhash64("line").alias("name"), F.length("line").alias("letters"))


def _asked(members: DataFrame, few: int) -> DataFrame:
    """`members` of the intervals in which a position still asks for a longer prefix."""
    return _told(members, members.groupBy("name").agg(F.max("asks").alias("asked"), F.count("*").alias("c")).where("asked").select("name", "c"), few)


def _levels(docs: DataFrame, copies: DataFrame, min_words: int, few: int) -> list[DataFrame]:
    """For each level k its repeated names: doc_id, tkey, i, name, first (position)."""
    spark = docs.sparkSession
    with scope() as own:
        lines = cut(line_table(docs), "lines")
        gone = copies.select(F.col("doc_id").alias("c_doc_id"), F.col("tkey").alias("c_tkey"))
        if copies.limit(few + 1).count() <= few:
            gone = F.broadcast(gone)
        lines = lines.join(gone, _same("", "c_"), "left_anti")
        level = _repeated(lines, few).repartition("doc_id", "tkey").dropDuplicates(AT)
    stretch = level.withColumn("s", F.col("i") - F.row_number().over(Window.partitionBy("doc_id", "tkey").orderBy("i")))
    # a line of n letters has (n + 1) / 2 words at most
    most = F.sum(F.floor((F.col("letters") + 1) / 2)).over(Window.partitionBy("doc_id", "tkey", "s"))
    level = cut(stretch.withColumn("most", most).where(F.col("most") >= min_words).select(*AT, "name", "first"), "level")
    drop(spark, own)
    levels = [level]
    while level.take(1):
        step = 1 << (len(levels) - 1)
        after = level.select(F.col("doc_id").alias("a_doc_id"), F.col("tkey").alias("a_tkey"), (F.col("i") - step).alias("a_i"), F.col("name").alias("a_name"))
        pairs = level.join(after, _same("", "a_") & (F.col("i") == F.col("a_i"))).select(*AT, F.xxhash64("name", "a_name", F.lit(len(levels))).alias("name"))
        with scope() as own:
            repeated = _repeated(cut(pairs, "pairs"), few).select(*AT, "name", "first")
        level = cut(repeated, "level")
        drop(spark, own)
        levels.append(level)
    return levels[:-1] or levels


def _entering(levels: list[DataFrame]) -> DataFrame:
    """doc_id, tkey, i, k, name, length, asks: the positions of each level's names, those that ask there and those that stand for others.

    A position asks at the highest level at which it has an earlier partner. At lower ones the first of those it shares the next level with stands for it.
    """
    found = None
    for k, lv in enumerate(levels):
        rows = lv.select(*AT, F.lit(k).alias("k"), "name", (F.col("first") < _place()).alias("asks"))
        found = rows if found is None else found.union(rows)
    found = found.withColumn("asks_next", F.lead("asks").over(Window.partitionBy(*AT).orderBy("k"))).where("asks_next IS NOT TRUE")
    return found.select(*AT, "k", "name", F.expr("shiftleft(1, k)").alias("length"), "asks")


def _narrowed(rows: DataFrame, level: DataFrame, j: int, few: int) -> DataFrame:
    """Members of intervals (doc_id, tkey, i, length, asks, name) by the names of level j that follow: those of longer intervals, and in the old ones who stays."""
    longer = level.select(*[F.col(c).alias(f"n_{c}") for c in AT], F.col("name").alias("n_name"))
    new_name = F.when(F.col("n_name").isNotNull(), F.xxhash64("name", "n_name", F.lit(-j - 1)))
    rows = rows.join(longer, _same("", "n_") & (F.col("i") + F.col("length") == F.col("n_i")), "left")
    rows = cut(rows.select(*AT, "length", "asks", F.col("name").alias("was"), new_name.alias("name")), "longer")
    on, ended = rows.where("name IS NOT NULL"), rows.where("name IS NULL").select(*AT, "length", "asks", F.col("was").alias("name"))
    last = F.max(F.when(F.col("asks"), _place()))
    groups = on.groupBy("name").agg(F.min(_place()).alias("first"), last.alias("last"), F.count("*").alias("c")).where("c > 1")
    groups = groups.select("name", "first", F.coalesce(F.col("first") < F.col("last"), F.lit(False)).alias("goes"), "c")
    moves = F.coalesce(F.col("asks") & (F.col("first") < _place()), F.lit(False))
    if j == 0:  # the end: only those that ask are wanted
        on = _told(on.where("asks"), groups.where("goes"), few, "left").select(*AT, (F.col("length") + moves.cast("int")).alias("length"), "asks", "name")
        return on.union(ended.where("asks"))
    on = cut(_told(on, groups, few, "left"), "told")
    new = on.where("goes").select(*AT, (F.col("length") + (1 << j)).alias("length"), moves.alias("asks"), "name")
    # the first of a longer stretch stands for all who share it: they would meet the same names at each further step of the old interval
    stay = on.where(F.col("first").isNull() | (F.col("first") == _place())).select(*AT, "length", "asks", F.col("was").alias("name"))
    return _asked(stay.union(ended), few).select(*AT, "length", "asks", "name").union(new)


def _longest(levels: list[DataFrame], few: int) -> DataFrame:
    """doc_id, tkey, i, length: the longest run that starts at each position and occurs earlier."""
    spark = levels[0].sparkSession
    with scope() as own:
        members = _asked(cut(_entering(levels), "members"), few)
    members = cut(members, "intervals")
    drop(spark, own)
    active, before = None, []
    for j in range(len(levels) - 2, -1, -1):
        with scope() as own:
            rows = members.where(F.col("k") == j + 1).select(*AT, "length", "asks", "name")
            active = _narrowed(rows if active is None else active.union(rows), levels[j], j, few)
        with scope() as kept:
            active = cut(active, "active") if j else active
        active = active if j else cut(active, "longest")
        drop(spark, own + before)
        before = kept
    settled = members.where("asks AND k = 0")
    return (settled if active is None else settled.select(*active.columns).union(active)).select(*AT, "length")


def repeated_runs(docs: DataFrame, min_words: int = 0, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(maximal repeated runs that are later copies: doc_id, tkey, i, lines; later copies of whole texts: doc_id, tkey).

    The first table covers the documents that aren't in the second; of its runs all those of `min_words` words are there, of shorter ones not all.
    """
    copies = cut(later_copies(docs), "copies")
    with scope() as own:
        longest = _longest(_levels(docs, copies, min_words, few), few)
    longest = cut(longest, "longest")
    drop(docs.sparkSession, own)
    before = Window.partitionBy("doc_id", "tkey").orderBy("i")
    longest = longest.withColumns({"p_i": F.lag("i").over(before), "p_length": F.lag("length").over(before)})
    inside = F.coalesce((F.col("p_i") == F.col("i") - 1) & (F.col("p_length") > F.col("length")), F.lit(False))
    return longest.where(~inside).select(*AT, F.col("length").alias("lines")), copies


def dedupe(docs: DataFrame, min_words: int = MIN_WORDS, few: int = FEW) -> DataFrame:
    """`docs` with later copies of repeated runs deleted from `text`, and lines_deleted (int). Rows stay, even if their text is now empty."""
    runs, copies = repeated_runs(docs, min_words, few)
    # the words of a run are counted here, in the text itself; a copy is one run of all its lines; runs are bounded by their document
    of_doc = runs.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("i", "lines")).alias("runs"))
    of_doc = cut(of_doc.union(copies.select("doc_id", "tkey", F.array(F.struct(F.lit(0).alias("i"), F.lit(-1).alias("lines"))))), "runs")
    size = of_doc.agg(F.coalesce(F.sum(F.size("runs") + 2), F.lit(0)).alias("n")).first()["n"]
    doc, text_key, found = fresh(docs, "doc", "text_key", "runs")
    of_doc = of_doc.select(F.col("doc_id").alias(doc), F.col("tkey").alias(text_key), F.col("runs").alias(found))
    kept = docs.select(*[c for c in docs.columns if c != "lines_deleted"])
    hit = kept["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(kept["text"].cast("string")) == F.col(text_key))
    joined = kept.join(F.broadcast(of_doc) if size <= 2 * few else of_doc, hit, "left")
    lines = F.split("text", "\n")
    words = F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD)))
    (count,) = fresh(joined, "words_of_lines")
    joined = joined.withColumn(count, F.when(F.col(found).isNotNull(), words))
    length = lambda r: F.when(r["lines"] < 0, F.size(count)).otherwise(r["lines"])
    total = lambda r: F.aggregate(F.slice(F.col(count), r["i"] + 1, r["lines"]), F.lit(0), lambda a, x: a + x)
    whole = F.transform(F.col(found), lambda r: F.struct(r["i"].alias("i"), length(r).cast("int").alias("lines")))
    joined = joined.withColumn(found, whole).withColumn(found, F.filter(F.col(found), lambda r: total(r) >= min_words))
    (left,) = fresh(joined, "lines_left")
    covered = F.flatten(F.transform(F.col(found), lambda r: F.sequence(r["i"], r["i"] + r["lines"] - 1)))
    joined = joined.withColumn(left, F.when(F.size(found) > 0, F.array_except(F.sequence(F.lit(0), F.size(count) - 1), covered)))
    text = F.when(F.col(left).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    columns = [text.alias("text") if c == "text" else F.col(c) for c in kept.columns]
    return joined.select(*columns, F.when(F.col(left).isNull(), 0).otherwise(F.size(count) - F.size(left)).cast("int").alias("lines_deleted"))
