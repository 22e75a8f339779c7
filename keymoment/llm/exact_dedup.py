"""Exact dedup as a stateful stream with disk-backed keyed state, in DataFrame operations only.

Rows become headers: digest of the normalised text, length, stable id and content locator (file and row). Headers stream
through an aggregation whose state, kept per digest in RocksDB without expiry, is the header of the row that stays and a
count. A digest that came more than once is a hit: its rows' full bytes are compared (least and largest normalised text
of the digest, combined in each task before the shuffle). Texts that a sieve of the hits tells apart aren't shuffled. If
the bytes differ, which takes a digest collision, the digest's rows are grouped by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keymoment.llm.common import Scratch, Sieve, folders, located, without

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stream's session while it starts: state on disk, with small write buffers and no space allotted ahead,
#: as there may be many partitions.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    """The text without characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def headers(rows: DataFrame, id_col: str, text_col: str, digest=sha256) -> DataFrame:
    """(digest, sha, less, id, file, row) of each row of a located() table; sha is null where digest is SHA-256 itself."""
    text = F.col(f"whole.`{text_col}`")
    plain = normalised(text)
    sha = F.lit(None).cast("string") if digest is sha256 else sha256(plain)
    return rows.select(digest(plain).alias("digest"), sha.alias("sha"), (-F.char_length(F.coalesce(text, F.lit("")))).alias("less"), F.col(f"whole.`{id_col}`").alias("id"), "file", "row")


def keepers(stream: DataFrame) -> DataFrame:
    """The state: for each digest, the header of the row that stays and how many rows came."""
    best = F.struct("less", F.col("id").isNull().alias("no_id"), "id", "file", "row")
    return stream.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("n"))


def run_stream(spark: SparkSession, source: str, schema, scratch: Scratch, files_per_batch: int | None = None) -> DataFrame:
    """Stream the header files of a folder through the state; (digest, best, n) as of the end. A lost executor's state comes
    back from the checkpoint, and a batch that is written again replaces its own folder. files_per_batch bounds the headers
    (not the texts) that one batch takes in."""
    updates = f"{scratch.path}/updates"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    had = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        state = keepers(reader.parquet(source))
        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{scratch.path}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in had.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    batches = [f"{updates}/{name}" for name in folders(spark, updates)]
    said = spark.read.schema(state.schema).parquet(*batches) if batches else spark.createDataFrame([], state.schema)
    return scratch.keep(said.groupBy("digest").agg(F.min("best").alias("best"), F.max("n").alias("n")), "state")


def groups(rows: DataFrame, scratch: Scratch, id_col: str, text_col: str, digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """(id, keep_id, n, kept, sha, file, row) of each row of a located() table."""
    made = scratch.keep(headers(rows, id_col, text_col, digest), "headers")
    state = run_stream(rows.sparkSession, f"{scratch.path}/headers", made.schema, scratch, files_per_batch)
    hits = scratch.keep(state.where("n > 1").select("digest"), "hits")
    text = normalised(F.col(f"whole.`{text_col}`"))
    bodies = Sieve(hits, "digest").split(rows.select(text.alias("text"), digest(text).alias("digest"), "file", "row"), "digest", passing=True)
    odd = bodies.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("digest")
    odd = scratch.keep(odd, "collisions")
    kept = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    columns = ["id", F.col("best.id").alias("keep_id"), "n", kept.alias("kept"), F.coalesce("sha", "digest").alias("sha"), "file", "row"]
    if odd.isEmpty():
        scratch.drop("stream", "updates", "hits", "collisions")
        return made.join(state, "digest").select(*columns)
    split = bodies.join(odd, "digest", "left_semi").select("file", "row", sha256(F.concat(F.lit("part "), "text")).alias("part"))
    split = scratch.keep(made.join(split, ["file", "row"]), "split")
    best = keepers(split.withColumn("digest", F.concat("digest", "part"))).withColumnRenamed("digest", "part")
    plain = made.join(odd, "digest", "left_anti").join(state, "digest").select(*columns)
    return plain.unionAll(split.withColumn("part", F.concat("digest", "part")).join(best, "part").select(*columns))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row for each row of docs, dropped ones too: the id, keep_id, group_size, kept and text_sha256.

    Texts are equal when identical without white space; null counts as empty, so null, empty and blank texts are one
    group. The row with the most code points stays, then the smallest id (null ids last); of rows that tie in both, the
    first by locator, so exactly one row of a group is kept. docs that don't read files are written first, which gives the
    locator. Its other columns are ignored, whatever their names. An empty table gives an empty one. digest may be any
    Column function of the normalised text; a weak one only costs the rows whose digests collide another grouping.
    """
    scratch = Scratch(docs.sparkSession)
    out = groups(located(docs, scratch), scratch, id_col, text_col, digest, files_per_batch)
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns, whatever their names. Only rows to be dropped
    (and the few others that a sieve lets pass) are shuffled with their texts."""
    scratch = Scratch(docs.sparkSession)
    rows = located(docs, scratch)
    gone = groups(rows, scratch, id_col, text_col, digest, files_per_batch).where("NOT kept").select("file", "row")
    gone = scratch.keep(gone, "gone")
    scratch.drop_but("located", "gone")
    return without(rows, gone)
