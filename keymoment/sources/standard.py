"""The logical tables over the standard Parquet tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FPS = 25


def video_id(label) -> Column:
    return F.concat(F.lit("V"), F.lpad(label.cast("string"), 3, "0"))


def _signature(spark: SparkSession, path: str) -> str:
    """What changes when a table's files do: a hash of their names, lengths and times."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    said = "|".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files))
    return hashlib.md5(said.encode()).hexdigest()


class Tables:
    """Frames, features, OCR, speech, detections, videos, ground truth and predictions, derived from the tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """df over all cores, if its scan has fewer tasks than there are: a file of one row group is one task. A table of
        many files is left as it is and not shuffled."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @property
    def shared(self) -> str:
        """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one of a local session."""
        sc = self.spark.sparkContext
        conf = sc.getConf().get("spark.checkpoint.dir")
        if not conf:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            if not sc._jsc.sc().getCheckpointDir().isDefined():
                sc.setCheckpointDir(tempfile.mkdtemp(prefix="keymoment-"))
            conf = sc._jsc.sc().getCheckpointDir().get()
        return f"{conf.rstrip('/')}/keymoment-streams"

    def vector(self, vec_id: int) -> list[float]:
        return list(self.read("embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])

    def work(self) -> str:
        """A new folder for tables on the way to a result, in the shared one."""
        return f"{self.shared}/work/{self.spark.sparkContext.applicationId}/{uuid.uuid4().hex}"

    def vectors(self, ids: tuple[int, ...]) -> DataFrame:
        """(query_id, vector) of some rows, named e<id>."""
        return self.read("embeddings").where(F.col("vec_id").isin(*ids)).select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("query_id"), F.col("embedding").alias("vector"))

    @cached_property
    def n(self) -> int:
        return self.read("embeddings").count()

    def index(self, name: str) -> str:
        """The folder of the BM25 index of "ocr" or "asr", built on first use and again when the table's files change."""
        from keymoment.functions.text import tokens_dual
        from keymoment.operators.bm25_index import write_index

        table, doc, text = {"ocr": ("documents", "doc_id", "ocr_text"), "asr": ("conversations", "seg_id", "transcript")}[name]
        path = f"{self.shared}/bm25/{self.spark.sparkContext.applicationId}/{name}-{_signature(self.spark, f'{self.folder}/{table}.parquet')}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/corpus/_SUCCESS")  # written last
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            docs = self.ocr if name == "ocr" else self.spread(self.segments)
            write_index(docs, doc, tokens_dual(F.col(text)), path, sets=True)
        return path

    @property
    def segments(self) -> DataFrame:
        """transcripts with a number for each."""
        return self.transcripts.withColumn("seg_id", F.col("conv_id") * 100 + F.col("turn"))

    @property
    def frames(self) -> DataFrame:
        """global_id, video_id, keyframe_index, pts_ms, pts_time, fps, frame_idx, embedding."""
        e = self.read("embeddings")
        order = Window.partitionBy("label").orderBy("vec_id")
        return e.select(
            F.col("vec_id").alias("global_id"), video_id(F.col("label")).alias("video_id"), F.row_number().over(order).alias("keyframe_index"), (F.col("vec_id") * 2000).alias("pts_ms"),
            (F.col("vec_id") * 2.0).alias("pts_time"), F.lit(float(FPS)).alias("fps"), (F.col("vec_id") * 50).alias("frame_idx"), "embedding",
        )

    @property
    def features(self) -> DataFrame:
        """frames without keyframe_index, which needs no shuffle."""
        return self.read("embeddings").select(F.col("vec_id").alias("global_id"), video_id(F.col("label")).alias("video_id"), (F.col("vec_id") * 2000).alias("pts_ms"), (F.col("vec_id") * 50).alias("frame_idx"), "embedding")

    @property
    def ocr(self) -> DataFrame:
        return self.spread(self.read("documents").select("doc_id", "text")).select("doc_id", (F.col("doc_id") % self.n).alias("global_id"), F.col("text").alias("ocr_text"))

    @property
    def transcripts(self) -> DataFrame:
        start = F.col("conv_id") * 4000 + F.col("turn") * 1000
        end = start + 3000
        return self.read("conversations").select("conv_id", "turn", video_id(F.col("conv_id") % 10).alias("video_id"), start.alias("start_ms"), end.alias("end_ms"), F.expr("(conv_id * 4000 + turn * 1000) * 25 div 1000").alias("start_frame"), F.expr("(conv_id * 4000 + turn * 1000 + 3000) * 25 div 1000").alias("end_frame"), F.col("text").alias("transcript"))

    @property
    def objects(self) -> DataFrame:
        return self.read("events").select("event_id", (F.col("event_id") % self.n).alias("global_id"), F.col("event_type").alias("entity"), F.least(F.lit(1.0), F.col("value") / 50.0).alias("score"))

    @property
    def ground_truth(self) -> DataFrame:
        """For each video the interval of its frames 3 to 5, and events at 2, 4 and 6."""
        f = self.frames.where("keyframe_index <= 6")
        at = lambda k: F.max(F.when(F.col("keyframe_index") == k, F.col("frame_idx")))
        return f.groupBy("video_id").agg(at(3).alias("start_frame"), at(5).alias("end_frame"), at(2).alias("e1"), at(4).alias("e2"), at(6).alias("e3"), F.min("global_id").alias("first_id")).withColumn("query_id", F.concat(F.lit("q-"), "video_id"))

    @property
    def predictions(self) -> DataFrame:
        """For each video's first vector the 100 nearest frames."""
        from keymoment.operators.search import knn_batch

        firsts = self.ground_truth.select("query_id", F.col("first_id").alias("global_id")).join(self.features.select("global_id", F.col("embedding").alias("vector")), "global_id")
        return knn_batch(self.features, firsts, 100)
