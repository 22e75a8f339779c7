"""A corpus pipeline: toxicity, exact dedup, near-dedup, benchmark decontamination, mixing.

Each stage reads the table that the one before has written. A null text counts as an empty one, which no stage but the mix
rejects: empty texts are one group of exact duplicates, of which one row stays, have no shingles and no passages, and
the mix takes no rows without words. Rows are told apart by where they lie, so null or repeated ids lose no row, and of
rows that are equal in all one stays. Columns beside those of documents go through all stages, whatever their names, but
for `copies`, which the mix sets. An empty table goes through as one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keymoment.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from keymoment.llm.common import Scratch, located, table, without

#: Rows and bytes of whole texts that go to a Python worker at once, while a stage runs; of a longer text, one row.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}


def in_small_batches(stage: Callable) -> Callable:
    """The stage, with BATCH_ROWS and BATCH_BYTES while it runs, whoever calls it. That holds for the tables that the stage writes, so its
    result, which the caller runs, must have no Python left in it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        had = {k: spark.conf.get(k, None) for k in _BATCH}
        for k, v in _BATCH.items():
            spark.conf.set(k, v)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            for k, v in had.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    return run_stage


def without_marked(docs: DataFrame, marked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs, but those whose places marked(texts) has; texts: (file, row, text) of each row. Each text goes to
    Python once, without the rest of its row, and places alone come back."""
    scratch = Scratch(docs.sparkSession)
    rows = located(docs, scratch)
    gone = marked(rows.select("file", "row", F.col("whole.`text`").alias("text"))).select("file", "row")
    return without(rows, scratch.keep(gone, "gone"))


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels that aren't held out, doesn't call toxic. Without labels of
    both sorts it calls none, or all, toxic, as the labels that there are say; without any, none."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return without_marked(docs, lambda texts: toxicity.score_toxicity(texts, model, "text", ["file", "row"]).where("predicted = 1"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the most code points, then the smallest id (null last), then
    the first by place."""
    return exact_dedup.drop_exact_duplicates(docs)


@in_small_batches
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id (null last), then the first by place."""
    return near_dedup.drop_near_duplicates(docs)


@in_small_batches
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, short items included; null and empty items are passages of none."""
    items = table(spark, sf_dir, "benchmark")
    return without_marked(docs, lambda texts: decontaminate.mark_leaks(texts, items, "text", keep=["file", "row"], min_words=1).where(F.size("leaks") > 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the copies that it takes of each; a null source is a source of its own."""
    return mixing.take_mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The trained classifier and the walks can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage keeps. Of the tables written on the way, the operators' are deleted after their stage, and a
    stage's own once the next one is written."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with scratch.lent(f"{name}-work"):
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
