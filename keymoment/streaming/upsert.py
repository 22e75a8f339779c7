"""Incremental ingest: keep the last row of each key, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keymoment.operators.quality import upsert_keep_last


def keep_last_stream(stream: DataFrame, key: list[str], order: list[str], target: str, checkpoint: str):
    """Start a stream that merges each micro-batch into a versioned Parquet table under target; (query).

    A batch is first reduced to a row a key, then merged with the version before and written as version=<batch>, so a
    batch that is run again writes the same folder again and readers see whole versions only."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        had = versions(spark, target)
        before = [v for v in had if v < number]
        rows = batch
        if before:
            rows = rows.unionByName(spark.read.parquet(f"{target}/version={before[-1]}").select(*batch.columns))
        upsert_keep_last(rows, key, order).select(*batch.columns).write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))


def latest(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/version={versions(spark, target)[-1]}")
