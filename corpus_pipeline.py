"""The corpus pipeline: documents in, placed training documents out, stage by stage.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows and further columns of any name, and an empty table; what each
does with them is told in its text. All but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docwatch.llm import common, decontaminate, mixing, ngram_join, sharding, toxicity
from docwatch.session import table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel classifier rejects go. Null and empty texts hold no evidence and stay; repeated rows have one score and stay or go together."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a Jaccard similarity of 0.8 stays: that of least doc_id, of equal ids that of least text hash.

    Rows with one doc_id and text are one document, one of them stays. Null and empty texts are linked with nothing and all stay.
    """
    return ngram_join.dedupe(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each repeated row with them; null and empty texts hold none and stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken not at all, once or twice, so that the sources come near their targets.

    A null source is one of its own, the last; null and empty texts have size 0. Rows equal in id, source and text are drawn one by one.
    """
    return mixing.mix(docs)


def shard_placement(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets its slot and shard, by its doc_id alone: repeated rows come to one shard, a null id to that of the empty text. Columns slot and shard are replaced."""
    return sharding.place(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shard_placement),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder that the next one reads.

    A stage's own tables go when its result is written, and that when the next one's is; tables of other work in the session stay.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with common.scope() as own:
            out = stage(spark, docs, sf_dir)
        with common.scope() as kept:
            docs = common.cut(out, f"stage-{name}")
        common.drop(spark, own)
        common.drop(spark, before)
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
