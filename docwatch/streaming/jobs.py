"""Structured Streaming forms of the batch operators. Each replays to the same rows as its batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from docwatch.operators import feeds, messages
from docwatch.operators.monitor import BLOCKED, OPEN_AT, with_category


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; replayed files must be written in time order."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(df: DataFrame, each: Callable[[DataFrame, int], None] | None, checkpoint: str, path: str | None = None, mode: str = "append") -> StreamingQuery:
    """Run a stream over all there is now and stop. A restart with the same checkpoint continues and adds nothing twice."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").start(path)
    q.awaitTermination()
    return q


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at `path`; without rows where it isn't there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _before(path: str, batch_id: int, spark: SparkSession, schema) -> DataFrame:
    """The rows that batches before `batch_id` wrote to `path` (a folder for each batch)."""
    known = T.StructType([*(f for f in schema.fields if f.name != "batch"), T.StructField("batch", T.LongType())])
    return _table(spark, path, known).where(F.col("batch") < batch_id).drop("batch")


def _put(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch to its own folder: a batch that is run again after a crash replaces what it wrote before."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def collect(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> None:
    """Add to the target table (a folder for each batch) the rows of each batch whose keys it doesn't have yet."""

    def put(batch: DataFrame, batch_id: int) -> None:
        known = _before(target, batch_id, batch.sparkSession, batch.schema)
        _put(messages.insert_ignore(known, batch, keys), target, batch_id)

    drain(stream, put, checkpoint)


def stream_changes(stream: DataFrame, versions: str, checkpoint: str, key: str = "normalized_url", at: str = "collected_at") -> None:
    """Add to the version table the versions that each batch of captures brings: NEW pages and UPDATED ones, as `append_versions` tells them.

    stream: key, `at`, content_hash, blocked and columns to keep. The captures of a page within a batch are taken in order of time: of neighbours with one hash the
    first counts, and so does none that repeats the last version known. Batches must come in order of time. Each batch has a folder of its own, so a batch run again adds nothing twice.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        new = batch.where("NOT blocked").drop("blocked")
        schema = T.StructType([*new.schema.fields, T.StructField("status", T.StringType()), T.StructField("version", T.LongType())])
        known = _before(versions, batch_id, batch.sparkSession, schema)
        latest = known.groupBy(key).agg(F.max("version").alias("last_version"), F.max_by("content_hash", "version").alias("last_hash"))
        w = Window.partitionBy(key).orderBy(at, "content_hash")  # the captures of one page in one batch
        j = new.join(latest, key, "left").withColumn("before", F.coalesce(F.lag("content_hash").over(w), F.col("last_hash")))
        j = j.where(F.col("before").isNull() | (F.col("before") != F.col("content_hash")))
        n = F.coalesce("last_version", F.lit(0).cast("long")) + F.row_number().over(w)
        j = j.withColumn("status", F.when(F.col("before").isNull(), "NEW").otherwise("UPDATED")).withColumn("version", n.cast("long"))
        _put(j.select(*new.columns, "status", "version"), versions, batch_id)

    drain(stream, put, checkpoint)


def deduplicated(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key; state older than `delay` is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def bursts(stream: DataFrame, at: str, by: str, window: str, slide: str, delay: str, threshold: int) -> DataFrame:
    """(window, by, n) of sliding windows with at least `threshold` rows, given out once the watermark has passed them."""
    w = stream.withWatermark(at, delay).groupBy(F.window(at, window, slide), by).agg(F.count("*").alias("n"))
    return w.where(F.col("n") >= threshold).select(F.col("window.start").alias("start"), by, "n")


def sessions(stream: DataFrame, at: str, by: str, gap: str, delay: str) -> DataFrame:
    """(start, end, by, n) of runs of rows with no gap longer than `gap`."""
    s = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def removed_restored(stream: DataFrame, key: str = "domain", threshold: int = 3) -> DataFrame:
    """(key, outcome_id, event) as the batch operator: one count of failures per key is all the state."""

    def step(k: tuple, rows: Iterator, state: GroupState):
        import pandas as pd

        (failures,) = state.get if state.exists else (0,)
        out = []
        for r in sorted((r for p in rows for r in p.itertuples()), key=lambda r: (r.ts, r.outcome_id)):
            if r.success:
                if failures >= threshold:
                    out.append((k[0], r.outcome_id, "RESTORED"))
                failures = 0
            elif r.counts:
                failures += 1
                if failures == threshold:
                    out.append((k[0], r.outcome_id, "REMOVED"))
        state.update((failures,))
        yield pd.DataFrame(out, columns=[key, "outcome_id", "event"])

    counts = (~F.col("category").isin(*BLOCKED)) & (F.col("category") != "none")
    s = with_category(stream).select(key, "ts", "outcome_id", "success", counts.alias("counts"))
    return s.groupBy(key).applyInPandasWithState(step, f"{key} string, outcome_id long, event string", "failures int", "append", GroupStateTimeout.NoTimeout)


def circuit(stream: DataFrame, key: str = "domain", most_delay: float = 30_000.0) -> DataFrame:
    """(key, outcome_id, delay_ms, consecutive_failures, circuit_state) after each outcome.

    The delay is a fold over the outcomes of a key in order: a success takes a tenth off (below 50 ms it ends), a failure
    multiplies it by 1.5 (at least 200 ms), a block or throttle by 2 (at least 500 ms).
    """

    def step(k: tuple, rows: Iterator, state: GroupState):
        import pandas as pd

        delay, failures = state.get if state.exists else (0.0, 0)
        out = []
        for r in sorted((r for p in rows for r in p.itertuples()), key=lambda r: (r.ts, r.outcome_id)):
            if r.category == "none":
                failures, delay = 0, delay * 0.9
                delay = 0.0 if delay < 50 else delay
            else:
                failures += 1
                delay = min(most_delay, max(500.0, delay * 2) if r.category in BLOCKED else max(200.0, delay * 1.5))
            out.append((k[0], r.outcome_id, delay, failures, "open" if failures >= OPEN_AT else "degraded" if failures >= 3 else "healthy"))
        state.update((delay, failures))
        yield pd.DataFrame(out, columns=[key, "outcome_id", "delay_ms", "consecutive_failures", "circuit_state"])

    s = with_category(stream).select(key, "ts", "outcome_id", "category")
    return s.groupBy(key).applyInPandasWithState(step, f"{key} string, outcome_id long, delay_ms double, consecutive_failures int, circuit_state string", "delay double, failures int", "append", GroupStateTimeout.NoTimeout)


def split_late(stream: DataFrame, at: str, delay_seconds: int, kept: str, late: str, checkpoint: str) -> None:
    """Write rows to `kept`, or to `late` if they are older than the newest time of the batches before less the delay. Both together are the input.

    The newest time is read off the tables, where the batches before wrote it, so it outlives restarts; a batch run again replaces its own rows.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [_before(p, batch_id, spark, batch.schema).agg(F.max(at)).first()[0] for p in (kept, late)]
        bound = max((t for t in before if t is not None), default=None)
        cut = F.lit(None).cast("timestamp") if bound is None else F.lit(bound) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(delay_seconds)))
        is_late = F.coalesce(F.col(at) < cut, F.lit(False))
        _put(batch.where(~is_late), kept, batch_id)
        _put(batch.where(is_late), late, batch_id)

    drain(stream, put, checkpoint)


def matches(stream: DataFrame, keywords: list[str], **how) -> DataFrame:
    """Posts with a signal, as they come."""
    return feeds.match_keywords(stream, keywords, **how).where("signal")
