"""Channel messages: collection, search, links, sources and their access states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwatch.functions import urls as U

URL = r"(?i)https?://[^\s<>\"']+"
#: The access states a source may go to from each state.
TRANSITIONS = {
    "discovered": "public_accessible accessible join_request_required access_denied not_found error",
    "public_accessible": "monitoring error disabled public_accessible",
    "accessible": "monitoring error disabled accessible",
    "join_request_required": "join_request_pending joined error disabled",
    "join_request_pending": "join_request_pending join_request_approved join_request_rejected error",
    "join_request_approved": "joined error",
    "join_request_rejected": "disabled error",
    "joined": "monitoring error",
    "monitoring": "monitoring error disabled",
    "access_denied": "disabled error",
    "not_found": "disabled error discovered",
    "error": "discovered public_accessible accessible join_request_required access_denied not_found error disabled",
    "disabled": "discovered",
}
NOT_MONITORED = "error access_denied not_found join_request_required join_request_pending join_request_rejected disabled".split()


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `batch` to insert: one of each key (the least by the other columns, so a rerun takes the same), those with a key in `target` left out.

    How many were duplicates is the number of rows of `batch` less those of the result. Rows with a null in a key are never in `target`.
    """
    rest = [c for c in batch.columns if c not in keys]
    sortable = [c for c in rest if not batch.schema[c].dataType.typeName() in ("map", "variant")]
    one = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*sortable)).alias("r")).select(*keys, "r.*").select(*batch.columns) if sortable else batch.dropDuplicates(keys)
    return one.join(target.select(*keys).distinct(), keys, "left_anti")


def normalize_messages(raw: DataFrame, channel: Column) -> DataFrame:
    """Messages with empty text as null, a hash of the row, a link and has_media."""
    text = F.nullif(F.trim("text"), F.lit(""))
    link = F.concat(F.lit("https://t.me/"), channel, F.lit("/"), F.col("message_id").cast("string"))
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(raw.columns)]))
    return raw.withColumn("raw_hash", F.sha2(body, 256)).withColumns({"text": text, "message_url": link, "has_media": F.col("media_type").isNotNull()})


def explode_media(messages: DataFrame) -> DataFrame:
    """A row for each attachment."""
    return messages.where("media_type IS NOT NULL").select("source_id", "message_id", "media_type")


def collect_incremental(raw: DataFrame, target: DataFrame, checkpoints: DataFrame, limit: int) -> DataFrame:
    """Messages past each source's checkpoint, the oldest `limit` of each source, without those in `target`."""
    new = raw.join(checkpoints, "source_id", "left").where(F.col("message_id") > F.coalesce("checkpoint", F.lit(-1))).drop("checkpoint")
    w = Window.partitionBy("source_id").orderBy("message_id")
    picked = new.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= limit).drop("n__")
    return insert_ignore(target, picked, ["source_id", "message_id"])


def collect_backfill(raw: DataFrame, checkpoints: DataFrame, since: Column, limit: int) -> DataFrame:
    """Messages older than each source's checkpoint and not before `since`, the newest `limit` of each source."""
    old = raw.join(checkpoints, "source_id").where((F.col("message_id") < F.col("checkpoint")) & (F.col("message_date") >= since)).drop("checkpoint")
    w = Window.partitionBy("source_id").orderBy(F.col("message_id").desc())
    return old.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= limit).drop("n__")


def checkpoints(messages: DataFrame) -> DataFrame:
    return messages.groupBy("source_id").agg(F.max("message_id").alias("checkpoint"))


def _contains(c: str, q: str) -> Column:
    return F.contains(F.lower(F.col(c)), F.lit(q.lower()))


def search_messages(df: DataFrame, keyword: str | None = None, sender: str | None = None, start: str | None = None, end: str | None = None, media: str | None = None, dates: str = "strict") -> DataFrame:
    """Messages that pass every filter given. With dates="lenient" a message without a date passes the date filters."""
    out = df
    if keyword:
        out = out.where(_contains("text", keyword))
    if sender:
        out = out.where(F.col("sender_username") == sender)
    if media:
        out = out.where(F.col("media_type") == media)
    ok = F.lit(dates == "lenient")
    if start:
        out = out.where(F.coalesce(F.col("message_date") >= F.lit(start).cast("timestamp"), ok))
    if end:
        out = out.where(F.coalesce(F.col("message_date") <= F.lit(end).cast("timestamp"), ok))
    return out


def count_by_source(found: DataFrame) -> DataFrame:
    """(source_id, n, first_date, last_date) of found messages."""
    return found.groupBy("source_id").agg(F.count("*").alias("n"), F.min("message_date").alias("first_date"), F.max("message_date").alias("last_date"))


def newest(found: DataFrame, most: int = 100) -> DataFrame:
    """The `most` newest of found messages; those without a date come last."""
    return found.orderBy(F.col("message_date").desc_nulls_last(), F.col("message_id").desc(), "source_id").limit(most)


def keyset_page(df: DataFrame, before: int | None, limit: int, order: str = "message_id") -> DataFrame:
    """The newest rows with `order` below the cursor: `limit` (1 to 100) of them, with has_more on each and next_cursor of the page."""
    n = min(100, max(1, limit))
    page = (df.where(F.col(order) < before) if before is not None else df).orderBy(F.col(order).desc()).limit(n + 1)
    w = Window.orderBy(F.col(order).desc())  # n + 1 rows
    page = page.withColumn("n__", F.row_number().over(w))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    more = F.max("n__").over(whole) > n
    page = page.withColumn("has_more", more).where(F.col("n__") <= n)
    return page.withColumn("next_cursor", F.when(F.col("has_more"), F.min(order).over(whole))).drop("n__")


def multi_source_search(sources: DataFrame, messages: DataFrame, keyword: str, allowed: list[str]) -> DataFrame:
    """Hits of the sources whose access_status allows it, and a row with a reason for each of the others."""
    ok = sources.where(F.col("access_status").isin(allowed))
    hits = messages.join(ok.select("source_id"), "source_id", "left_semi").where(_contains("text", keyword))
    hits = hits.select("source_id", "message_id", F.lit(None).cast("string").alias("skipped"))
    out = sources.join(ok.select("source_id"), "source_id", "left_anti")
    return hits.unionByName(out.select("source_id", F.lit(None).cast("long").alias("message_id"), F.concat(F.lit("status:"), "access_status").alias("skipped")))


def channel_summary(df: DataFrame, names: list[str], order: str) -> DataFrame:
    """Distinct channel labels (the first of `names` that is there, else unknown) in first-seen order, with counts."""
    label = F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit("unknown"))
    return df.groupBy(label.alias("label")).agg(F.min(order).alias("first_seen"), F.count("*").alias("messages"))


def discover_links(messages: DataFrame, known: DataFrame, per_message: int = 10) -> DataFrame:
    """Channels linked from messages: kind, normalized, mentions, first source and message, already_known. The first `per_message` links of a message count."""
    links = messages.select("source_id", "message_id", F.posexplode(F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(URL), F.lit(0))), 1, per_message)).alias("i", "url"))
    found = links.withColumn("c", U.classify_channel_url(F.regexp_replace("url", r"[.,;:!?)\]]+$", ""))).where("c IS NOT NULL")
    out = found.groupBy("c.kind", "c.normalized").agg(F.count("*").alias("mentions"), F.min(F.struct("source_id", "message_id")).alias("f"))
    out = out.select("kind", "normalized", "mentions", F.col("f.source_id").alias("first_source"), F.col("f.message_id").alias("first_message"))
    return out.join(known.select("normalized").distinct().withColumn("already_known", F.lit(True)), "normalized", "left").withColumn("already_known", F.coalesce("already_known", F.lit(False)))


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """`sources` (id, entity_id) with canonical_id, the least id of the same entity; rows without an entity are their own."""
    least = sources.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.min("id").alias("least__"))
    return sources.join(least, "entity_id", "left").withColumn("canonical_id", F.coalesce("least__", "id")).drop("least__")


def transitions(history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`history` with previous state and valid: whether the change is allowed (the first state is), and must_not_monitor."""
    pairs = [(a, b) for a, to in TRANSITIONS.items() for b in to.split()]
    table = history.sparkSession.createDataFrame(pairs, "previous string, state string").withColumn("ok", F.lit(True))  # under a hundred rows
    h = history.withColumn("previous", F.lag("state").over(Window.partitionBy(key).orderBy(*order)))
    h = h.join(F.broadcast(table), ["previous", "state"], "left")
    return h.withColumns({"valid": F.coalesce("ok", F.col("previous").isNull()), "must_not_monitor": F.col("state").isin(NOT_MONITORED)}).drop("ok")


def notifications(history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of `history` at which the state of a source changed: key, order columns, previous, state."""
    h = history.withColumn("previous", F.lag("state").over(Window.partitionBy(key).orderBy(*order)))
    return h.where(F.col("previous").isNotNull() & (F.col("previous") != F.col("state"))).select(key, *order, "previous", "state")
