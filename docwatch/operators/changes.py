"""Change detection between two captures of a page, and the version history that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docwatch.functions import text as X

NEWS = ("NEWS_ARTICLE", "BLOG_POST")
FORUM = ("FORUM_THREAD", "FORUM_INDEX", "DISCUSSION_THREAD")
LISTING = ("CLASSIFIED_LISTING", "EVENT", "JOB")
INDEX = ("CLASSIFIED_INDEX", "SEARCH_RESULTS", "CATEGORY", "NEWS_INDEX", "DIRECTORY")

def _counts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType()) for n in names])


@F.pandas_udf(_counts("added", "removed", "modified", "unchanged"))
def paragraph_diff(old, new):
    """Paragraphs added, removed, modified and unchanged between two texts (split at blank lines, else at lines; white space and case don't count).

    The alignment of two lists has no built-in; call it only on rows whose normalized texts differ.
    """
    import pandas as pd
    from difflib import SequenceMatcher

    def parts(t):
        pieces = t.split("\n\n") if "\n\n" in t else t.split("\n")
        return [n for n in (" ".join(p.split()).lower() for p in pieces) if n]

    out = []
    for a, b in zip(old.fillna(""), new.fillna("")):
        added = removed = modified = same = 0
        for kind, i1, i2, j1, j2 in SequenceMatcher(None, parts(a), parts(b), False).get_opcodes():
            x, y = i2 - i1, j2 - j1
            if kind == "equal":
                same += x
            else:
                modified += min(x, y)
                removed += max(0, x - y)
                added += max(0, y - x)
        out.append((added, removed, modified, same))
    return pd.DataFrame(out, columns=["added", "removed", "modified", "unchanged"])


@F.pandas_udf(_counts("added_lines", "removed_lines"))
def line_diff(old, new):
    """Lines that a unified diff of two texts adds and removes."""
    import pandas as pd
    from difflib import SequenceMatcher

    out = []
    for a, b in zip(old.fillna(""), new.fillna("")):
        a, b = a.splitlines(), b.splitlines()
        same = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        out.append((len(b) - same, len(a) - same))
    return pd.DataFrame(out, columns=["added_lines", "removed_lines"])


def _names(*pairs: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))


def detect_changes(prev: DataFrame, curr: DataFrame, key: str = "normalized_url") -> DataFrame:
    """One row for each key in both: changed, change_type, severity, similarity, confidence, changed_fields.

    Both have key, page_type, title, body, price, status and simhash (may be null). Pages equal in all of these (white space and case
    of the texts apart) are decided first; paragraphs are aligned only for news whose body, not title, changed.
    """
    fields = ("title", "body", "price", "status", "simhash")
    side = lambda df, p: df.select(key, *[F.col(f).alias(f"{p}_{f}") for f in fields], *([F.col("page_type")] if p == "c" else []))
    j = side(prev, "p").join(side(curr, "c"), key)
    title = X.scalar_changed(F.col("p_title"), F.col("c_title"))
    body = ~X.normalize_text(F.col("p_body")).eqNullSafe(X.normalize_text(F.col("c_body")))
    old, new = X.to_number(F.col("p_price")), X.to_number(F.col("c_price"))
    j = j.withColumns({"title_changed": title, "body_changed": body, "price_changed": ~old.eqNullSafe(new), "status_changed": X.scalar_changed(F.col("p_status"), F.col("c_status"))})
    j = j.withColumns({"tier": X.simhash_tier(F.col("p_simhash"), F.col("c_simhash")), "near": X.simhash_similarity(F.col("p_simhash"), F.col("c_simhash"))})
    news, listing = F.col("page_type").isin(*NEWS), F.col("page_type").isin(*LISTING)
    t, b, p, s = (F.col(f"{n}_changed") for n in ("title", "body", "price", "status"))
    ask = news & b & ~t
    j = j.withColumn("d", F.when(ask, paragraph_diff(F.when(ask, F.col("p_body")), F.when(ask, F.col("c_body")))))
    moved = F.col("d.added") + F.col("d.removed") + F.col("d.modified")
    meta = F.lit("METADATA_CHANGED")
    kind = (
        F.when(news, F.when(t & b, "ARTICLE_UPDATED").when(t, "TITLE_CHANGED").when(b, "CONTENT_CHANGED").when(p | s, meta))
        .when(listing, F.when(p, "PRICE_CHANGED").when(s, "STATUS_CHANGED").when(b, "DESCRIPTION_CHANGED").when(t, meta))
        .otherwise(F.when(b, "CONTENT_CHANGED").when(t, meta))
    )
    severity = (
        F.when(news, F.when(t & b, "HIGH").when(t, "MEDIUM").when(b, F.when(moved >= 3, "HIGH").when(moved >= 1, "MEDIUM").otherwise("LOW")).otherwise("LOW"))
        .when(listing, F.when(p | s, "HIGH").when(b, "MEDIUM").otherwise("LOW"))
        .otherwise(F.when(b, F.when(F.col("tier") == "near_identical", "LOW").when(F.col("tier") == "moderate", "MEDIUM").otherwise("HIGH")).otherwise("LOW"))
    )
    changed = kind.isNotNull()
    similarity = F.when((news | listing) & changed, F.when(b, F.col("near")).otherwise(1.0)).when(changed, F.col("near"))
    quiet = F.when((F.coalesce("p_simhash", F.lit(0)) != 0) & (F.coalesce("c_simhash", F.lit(0)) != 0), F.col("near")).otherwise(1.0)
    named = _names(("title", t), ("body", b & ~listing), ("description", b & listing), ("price", p & listing), ("status", s & listing))
    return j.select(
        key,
        "page_type",
        changed.alias("changed"),
        F.coalesce(kind, F.lit("NO_CHANGE")).alias("change_type"),
        F.when(changed, severity).otherwise("NONE").alias("severity"),
        F.coalesce(similarity, quiet).alias("similarity"),
        F.when(~changed, 1.0).when(news | listing, 0.9).otherwise(0.5).alias("confidence"),
        F.when(changed, named).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
    )


def collection_changes(prev: DataFrame, curr: DataFrame, key: str, item: str, compare: list[str]) -> DataFrame:
    """Changes of collections (listings of an index page, posts of a thread): per key added, removed, and changed counts of each of `compare`, and similarity = matched / all items."""
    a = prev.where(F.col(item).isNotNull()).select(key, item, F.lit(True).alias("in_p"), *[F.col(c).alias(f"p_{c}") for c in compare])
    b = curr.where(F.col(item).isNotNull()).select(key, item, F.lit(True).alias("in_c"), *[F.col(c).alias(f"c_{c}") for c in compare])
    j = a.join(b, [key, item], "full")
    both = F.col("in_p") & F.col("in_c")
    return j.groupBy(key).agg(
        F.count_if(F.col("in_p").isNull()).alias("added"),
        F.count_if(F.col("in_c").isNull()).alias("removed"),
        *[F.count_if(F.coalesce(both, F.lit(False)) & ~F.col(f"p_{c}").eqNullSafe(F.col(f"c_{c}"))).alias(f"{c}_changed") for c in compare],
        (F.count_if(F.coalesce(both, F.lit(False))) / F.count("*")).alias("similarity"),
    )


def index_change_type(c: DataFrame) -> DataFrame:
    """`collection_changes` of listings with price and status, with change_type and severity."""
    a, r, p, s = F.col("added") > 0, F.col("removed") > 0, F.col("price_changed") > 0, F.col("status_changed") > 0
    kind = F.when(~(a | r | p | s), "NO_CHANGE").when(a & ~r, "LISTING_ADDED").when(r & ~a, "LISTING_REMOVED").when(p, "PRICE_CHANGED").when(s, "STATUS_CHANGED").otherwise("STRUCTURE_CHANGED")
    severity = F.when(~(a | r | p | s), "NONE").when(a | r | p, "HIGH").otherwise("MEDIUM")
    return c.withColumns({"change_type": kind, "severity": severity})


def thread_change_type(c: DataFrame) -> DataFrame:
    """`collection_changes` of posts with body, with change_type and severity."""
    a, r, e = F.col("added"), F.col("removed") > 0, F.col("body_changed") > 0
    kind = F.when(r, "POST_REMOVED").when(e, "POST_EDITED").when(a > 0, "NEW_POSTS").otherwise("NO_CHANGE")
    severity = F.when(r, "HIGH").when(e, "MEDIUM").when(a >= 10, "HIGH").when(a > 0, "MEDIUM").otherwise("NONE")
    return c.withColumns({"change_type": kind, "severity": severity})


def append_versions(versions: DataFrame, incoming: DataFrame, key: str = "normalized_url") -> DataFrame:
    """Rows to append to `versions` (key, version, content_hash, ...): NEW pages as version 1, UPDATED ones as the next version; UNCHANGED and blocked ones give none.

    `incoming` has key, content_hash, blocked and the columns to keep; status tells NEW from UPDATED.
    """
    latest = versions.groupBy(key).agg(F.max("version").alias("last_version"), F.max_by("content_hash", "version").alias("last_hash"))
    j = incoming.where("NOT blocked").join(latest, key, "left")
    status = F.when(F.col("last_version").isNull(), "NEW").when(F.col("last_hash") != F.col("content_hash"), "UPDATED")
    j = j.withColumn("status", status).where("status IS NOT NULL")
    return j.withColumn("version", F.coalesce("last_version", F.lit(0)) + 1).drop("last_version", "last_hash", "blocked")


def history(versions: DataFrame, key: str = "normalized_url", at: str = "collected_at") -> DataFrame:
    """`versions` with valid_to (the time of the next version) and is_latest."""
    w = Window.partitionBy(key).orderBy("version")
    nxt = F.lead(at).over(w)
    return versions.withColumns({"valid_to": nxt, "is_latest": F.lead("version").over(w).isNull()})


def list_changes(versions: DataFrame, key: str = "normalized_url", at: str = "collected_at", since: Column | None = None, most: int = 100) -> DataFrame:
    """The `most` latest versions that changed a page (status UPDATED), with the hash before; since a time where given."""
    before = F.lag("content_hash").over(Window.partitionBy(key).orderBy("version"))
    c = versions.withColumn("previous_hash", before).where("status = 'UPDATED'")
    c = c if since is None else c.where(F.col(at) >= since)
    return c.orderBy(F.col(at).desc(), key, "version").limit(most)


def version_as_of(versions: DataFrame, ts: Column, key: str = "normalized_url", at: str = "collected_at") -> DataFrame:
    """The version of each page that was current at `ts`."""
    seen = versions.where(F.col(at) <= ts)
    rest = [c for c in versions.columns if c != key]
    return seen.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("v")).select(key, "v.*")


def run_stats(pages: DataFrame, job: str = "job_id") -> DataFrame:
    """Counters of each crawl job from its pages (status, strategy, change, content_bytes)."""
    return pages.groupBy(job).agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("fetched")).alias("fetched"),
        F.count_if(~F.col("fetched")).alias("failed"),
        F.count_if(F.col("change") == "NEW").alias("new"),
        F.count_if(F.col("change") == "UPDATED").alias("updated"),
        F.count_if(F.col("change") == "UNCHANGED").alias("unchanged"),
        F.count_if(F.col("strategy") == "http").alias("http"),
        F.count_if(F.col("strategy") == "browser").alias("browser"),
        F.coalesce(F.sum("content_bytes"), F.lit(0)).alias("bytes"),
    )
