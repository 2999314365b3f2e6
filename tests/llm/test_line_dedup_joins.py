"""Joins of many names: nothing is written over once for each salt, and names of very many positions don't meet in one task."""

from pyspark.sql import functions as F

from docwatch.llm import line_dedup


def test_many_names_are_joined_once(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 50, raising=False)
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("tkey"), F.lit(0).alias("i"), F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 40).cast("long").alias("name"))
    names = rows.groupBy("name").agg(F.min("doc_id").alias("first"), F.count("*").alias("c"))
    want = {(n, F_) for n, F_ in ((r.doc_id, 0 if r.doc_id < 200 or r.doc_id % 40 == 0 else r.doc_id % 40 + 200) for r in rows.collect())}
    for known in (names, names.drop("c")):
        told = line_dedup._told(rows, known, 3)
        got = [(r.doc_id, r["first"]) for r in told.collect()]
        assert len(got) == 400 and set(got) == want
        plan = told._jdf.queryExecution().toString()
        assert "Generate" not in plan and "Broadcast" in plan
        assert set(told.columns) == {"name", "doc_id", "tkey", "i", "first"}


def test_nested_copies_stay_linear(spark, monkeypatch):
    """Texts that share ever longer beginnings: a stretch stands once in the shorter ones it is part of, so no step holds more rows than twice the lines."""
    docs = [(d, "\n".join([f"w{i}" for i in range(2 * d + 2)] + [f"end {d}"])) for d in range(24)]
    sizes, cut = {}, line_dedup.cut

    def counted(df, name):
        out = cut(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    runs, copies = line_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.i, r.lines) for r in runs.collect()) == [(d, 0, 2 * d) for d in range(1, 24)] and not copies.take(1)
    lines = sum(2 * d + 3 for d in range(24))
    assert max(sizes.values()) <= 2 * lines, sizes
