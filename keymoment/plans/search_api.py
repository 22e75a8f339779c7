"""Search of a batch of queries: single moments, questions, sequences of events.

queries: query_id, task_type (kis, qa, trake), text, vector, and, each of which may be null: vector_en (of a translation),
ocr_keywords and asr_keywords (arrays), event_vectors (an array of vectors, in order) and answer (of a model, cached).
What models say comes in as columns, so a batch is one plan whatever the models are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keymoment.functions import text as X
from keymoment.functions.vectors import blend
from keymoment.operators import align, bm25_index, fusion, ranking, search, temporal
from keymoment.plans.ladder import LADDER, Config

#: Hits of one modality that lend a query's frames support.
SUPPORT = 200


@dataclass(frozen=True)
class Corpus:
    """frames: global_id, video_id, pts_ms, frame_idx, embedding. ocr and asr: folders of BM25 indexes, or functions that
    tell them, called when a batch searches text; ocr_docs (doc, global_id) and asr_docs (doc, video_id, frame_idx) say
    where their documents lie."""

    frames: DataFrame
    ocr: str | Callable[[], str] | None = None
    asr: str | Callable[[], str] | None = None
    ocr_docs: DataFrame | None = None
    asr_docs: DataFrame | None = None
    #: A folder that driver and executors share, for tables that several steps read; without one they are made again.
    work: str | None = None

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        if self.work is None:
            return df
        df.write.mode("overwrite").parquet(f"{self.work}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.work}/{name}")


def run(corpus: Corpus, queries: DataFrame, config: str = "a7", k: int = 100) -> DataFrame:
    """(query_id, task_type, rank, video_id, frame_idx, events, answer, score): k rows at most for each query. What only the
    other sort of queries needs isn't planned, nor are its indexes built."""
    c = LADDER[config]
    asked = {r["s"] for r in queries.select((F.col("task_type") == "trake").alias("s")).distinct().collect()}  # of a query set
    parts = [_sequences(corpus, queries.where("task_type = 'trake'"), c, k)] if True in asked else []
    if False in asked or not parts:
        parts = [_moments(corpus, queries.where("task_type <> 'trake'"), c, k), *parts]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def _query_vectors(queries: DataFrame, dual: bool) -> DataFrame:
    v = F.transform("vector", lambda x: x.cast("double"))
    return queries.select("query_id", (F.when(F.col("vector_en").isNotNull(), blend(F.col("vector"), F.col("vector_en"), 0.7, 0.3)).otherwise(v) if dual else v).alias("vector"))


def _support(corpus: Corpus, queries: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Best normalised scores of a modality, per (query, frame) and per (query, video)."""
    words = queries.select("query_id", F.explode(X.tokens_dual(F.array_join(f"{name}_keywords", " "))).alias("token"))
    asked = words.groupBy("query_id", "token").agg(F.count("*").cast("int").alias("c"))
    spark = queries.sparkSession
    index = getattr(corpus, name)
    hits = bm25_index.score(spark, index() if callable(index) else index, asked).where("score > 0")
    by = Window.partitionBy("query_id")
    hits = hits.withColumn("r", F.row_number().over(by.orderBy(F.desc("score"), "doc"))).where(F.col("r") <= SUPPORT)
    hits = hits.withColumn("norm", F.col("score") / F.greatest(F.max("score").over(by), F.lit(1e-6)))
    place = corpus.frames.select("global_id", "video_id", "frame_idx")
    if name == "ocr":
        at = hits.join(corpus.ocr_docs, "doc").join(place, "global_id")
    else:
        at = hits.join(corpus.asr_docs, "doc").join(place, ["video_id", "frame_idx"], "left")
    at = corpus.keep(at, f"{name}-hits")
    frame = at.where("global_id IS NOT NULL").groupBy("query_id", "global_id").agg(F.max("norm").alias(f"{name}_frame"))
    return frame, at.groupBy("query_id", "video_id").agg(F.max("norm").alias(f"{name}_video"))


def _moments(corpus: Corpus, queries: DataFrame, c: Config, k: int) -> DataFrame:
    hits = search.knn_batch(corpus.frames, _query_vectors(queries, c.dual), c.pool or k).drop("rank")
    if c.neighbour:
        hits = temporal.neighbor_max(hits, by=("query_id", "video_id"))
    for name in c.lexical:
        frame, video = _support(corpus, queries, name)
        hits = hits.join(frame, ["query_id", "global_id"], "left").join(video, ["query_id", "video_id"], "left")
    about = queries.select("query_id", "task_type", X.has_transition(F.col("text")).alias("transition"), F.col("answer"))
    rows = fusion.tnca_score(hits.join(F.broadcast(about), "query_id"), F.col("transition"), list(c.lexical), c.neighbour)  # a row a query
    order = Window.partitionBy("query_id").orderBy(F.round("final", 9).desc(), "global_id")
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = ranking.dedup_window(rows.select("query_id", "task_type", "rank", "video_id", "frame_idx", "answer", "final"), k)
    answer = F.when(F.col("task_type") == "qa", F.col("answer")) if c.answers else F.lit(None).cast("string")
    none = F.lit(None).cast("array<bigint>").alias("events")
    return rows.select("query_id", "task_type", F.col("place").cast("bigint").alias("rank"), "video_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), none, answer.alias("answer"), F.col("final").alias("score"))


def _sequences(corpus: Corpus, queries: DataFrame, c: Config, k: int) -> DataFrame:
    found = None
    # Queries of the same number of events share a plan; the numbers are few.
    sizes = [r["n"] for r in queries.select(F.coalesce(F.size("event_vectors"), F.lit(0)).alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    for n in sizes:
        own = queries.where(F.size("event_vectors") == n)
        part = _aligned(corpus, own, n, k) if c.alignment else _steps(corpus, own, n, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = _steps(corpus, queries, 1, k)
    answer = F.lit(None).cast("string").alias("answer")
    return found.select("query_id", F.lit("trake").alias("task_type"), "rank", "video_id", F.col("events")[0].alias("frame_idx"), "events", answer, "score")


def _steps(corpus: Corpus, queries: DataFrame, n: int, k: int) -> DataFrame:
    """Without alignment: the best frames, and the frames 25 apart behind each."""
    hits = search.knn_batch(corpus.frames, _query_vectors(queries, False), k)
    events = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.col("frame_idx") + 25 * i).cast("bigint"))
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "video_id", events.alias("events"), F.col("s").alias("score"))


def _aligned(corpus: Corpus, queries: DataFrame, n: int, k: int) -> DataFrame:
    """Videos near any event or the query, ordered by how well they cover the events; of the best, the runs of frames that
    follow the events in order."""
    each = queries.select("query_id", F.posexplode(F.concat("event_vectors", F.array("vector"))).alias("i", "v"))
    asked = each.select(F.concat("query_id", F.lit("\x1f"), F.col("i").cast("string")).alias("query_id"), F.col("v").alias("vector"))
    near = search.knn_batch(corpus.frames, asked, search.pool_size(k))
    videos = near.select(F.split("query_id", "\x1f")[0].alias("query_id"), "video_id").distinct()
    # Similarities of the candidates' frames to each event (e1..en) and to the query (e0).
    sims = search.all_similarities(corpus.frames, asked).select(F.split("query_id", "\x1f").alias("q"), "video_id", "pts_ms", "frame_idx", "global_id", "s")
    sims = sims.select(F.col("q")[0].alias("query_id"), F.col("q")[1].cast("int").alias("i"), "video_id", "pts_ms", "frame_idx", "global_id", "s").join(videos, ["query_id", "video_id"], "left_semi")
    pick = [F.max(F.when(F.col("i") == (i - 1 if i else n), F.col("s"))).alias(f"e{i}") for i in range(n + 1)]
    key = F.concat("query_id", F.lit("\x1f"), "video_id").alias("video_id")
    rows = sims.groupBy("query_id", "video_id", "pts_ms", "frame_idx", "global_id").agg(*pick).select(key, "pts_ms", "frame_idx", "global_id", *[f"e{i}" for i in range(n + 1)])
    rows = corpus.keep(rows, f"similar-{n}")
    # The peaks of all events at once, a video's event being a video of its own to them.
    long = rows.select("video_id", "pts_ms", F.posexplode(F.array(*[f"e{i}" for i in range(1, n + 1)])).alias("event", "s"))
    long = long.withColumn("video_id", F.concat("video_id", F.lit("\x1e"), F.col("event").cast("string")))
    peaks = align.nms_peaks(long.select("video_id", "pts_ms", "s"))
    peaks = peaks.select(F.split("video_id", "\x1e")[0].alias("video_id"), F.split("video_id", "\x1e")[1].alias("event"), ((F.col("p1") + F.col("p2") + F.col("p3")) / 3).alias("peak"))
    query = F.split("video_id", "\x1f")[0]
    peaks = temporal.minmax_norm(peaks.withColumn("query_id", query), "peak", ("query_id", "event"), "p", "one")
    scored = align.coverage_score(peaks, search.top_mean(rows.withColumn("s", F.col("e0")))).select("video_id", query.alias("query_id"), "coverage")
    best = scored.withColumn("v_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("coverage"), "video_id"))).where(F.col("v_rank") <= k)
    best = corpus.keep(best, f"best-{n}")
    mine = rows.join(best.select("video_id"), "video_id")
    smooth = mine.drop("e0", "global_id")
    for i in range(1, n + 1):
        smooth = temporal.minmax_norm(temporal.three_point_smooth(smooth, f"e{i}"), "smooth", ("video_id",), f"n{i}").drop("smooth")
    paths = align.segmental_dp(smooth.select("video_id", "pts_ms", "frame_idx", *[F.col(f"n{i}").alias(f"e{i}") for i in range(1, n + 1)]), n).select("video_id", "path")
    chosen = paths.select("video_id", "path", F.posexplode("path").alias("i", "frame_idx")).join(mine, ["video_id", "frame_idx"])
    raw = F.avg(F.element_at(F.array(*[f"e{i}" for i in range(1, n + 1)]), F.col("i") + 1))
    total = chosen.groupBy("video_id").agg(raw.alias("aligned"), F.first("path").alias("events")).join(best, "video_id")
    score = 3.0 / F.col("v_rank") + F.col("aligned") + F.col("coverage")
    total = total.select("query_id", F.split("video_id", "\x1f")[1].alias("video_id"), "events", score.alias("score"))
    total = total.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "video_id")).cast("bigint"))
    out = ranking.pad_to(ranking.dedup_sequence(total).select("query_id", "rank", "video_id", "events"), k, n)
    return out.join(total.select("query_id", "rank", "score"), ["query_id", "rank"], "left").select("query_id", "rank", "video_id", "events", "score")
