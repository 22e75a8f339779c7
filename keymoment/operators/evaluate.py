"""Graded retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTHS = (1, 5, 20, 50, 100)


def frame_distance(f: Column, start: Column, end: Column) -> Column:
    return F.greatest(start - f, F.lit(0), f - end)


def r_kis(video: Column, true_video: Column, f: Column, start: Column, end: Column) -> Column:
    return F.when((video == true_video) & f.between(start, end), 1.0).otherwise(0.0)


def r_qa(video: Column, true_video: Column, f: Column, start: Column, end: Column, match: Column) -> Column:
    """As r_kis, and the answer matches; match is null without a true answer, which counts as a match."""
    return F.when((video == true_video) & f.between(start, end) & F.coalesce(match, F.lit(True)), 1.0).otherwise(0.0)


def r_trake(video: Column, true_video: Column, frames: Column, starts: Column, ends: Column) -> Column:
    """The share of events whose frame at the same place lies within; missing frames miss."""
    events = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    hit = lambda e, i: F.coalesce(F.try_element_at(frames, i + 1).between(e["a"], e["b"]).cast("int"), F.lit(0))
    hits = F.aggregate(F.transform(events, hit), F.lit(0), lambda s, x: s + x)
    return F.when(video == true_video, F.try_divide(hits.cast("double"), F.size(starts))).otherwise(0.0)


def r_at_k(graded: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """r_1 .. r_100 (best r of the first k) and final, their mean, of graded(by..., rank, r)."""
    out = graded.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("r"))), F.lit(0.0)).alias(f"r_{k}") for k in DEPTHS])
    total = F.lit(0.0)
    for k in DEPTHS:
        total = total + F.col(f"r_{k}")
    return out.withColumn("final", total / len(DEPTHS))


def window_category(start: Column, end: Column) -> Column:
    d = F.greatest(F.lit(1), end - start + 1)
    return F.when(d <= 30, "SHORT").when(d <= 120, "MEDIUM").otherwise("LONG")


# The classes of a query's outcome, in the order in which they are asked for.
OUTCOMES = ("VIDEO_NOT_IN_TOP100", "VIDEO_LATE (>Top20)", "PERFECT_RANK_1", "PERFECT_IN_TOP5", "PARTIAL_HIT", "TEMPORAL_NEAR_MISS (<=25f)", "QA_ANSWER_MISMATCH", "FRAME_MISS")


def error_class(video_rank: Column, perfect: Column, positive: Column, distance: Column, mismatch: Column) -> Column:
    """The outcome of a query: from the right video's rank among videos, the ranks of the first perfect and first positive
    rows, the least distance to the interval, and whether an answer was wrong at a right frame of the first 20 rows."""
    lost, late, first, soon, some, near, answer, else_ = OUTCOMES
    return (
        F.when(video_rank.isNull(), lost).when(video_rank > 20, late).when(perfect == 1, first).when(perfect <= 5, soon).when(positive.isNotNull(), some)
        .when(distance <= 25, near).when(F.coalesce(mismatch, F.lit(False)), answer).otherwise(else_)
    )


def score_bucket(final: Column) -> Column:
    r = F.round(final, 1)
    return F.when(r >= 0.95, "1.0").when(r >= 0.75, "0.8").when(r >= 0.55, "0.6").when(r >= 0.35, "0.4").when(r >= 0.15, "0.2").otherwise("0.0")


def details(graded: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: r_at_k, the right video's rank among videos, reciprocal rank, first hit, first perfect row, least distance
    and error class. graded has query_id, rank, video_id, frame_idx, r and, for questions, match (whether the answer is
    right); truth query_id, true_video, start_frame, end_frame."""
    from keymoment.operators.ranking import video_order

    order = video_order(graded).join(truth.select("query_id", F.col("true_video").alias("video_id")), ["query_id", "video_id"]).select("query_id", "video_rank")
    d = frame_distance(F.col("frame_idx"), F.col("start_frame"), F.col("end_frame"))
    wrong = F.max((d == 0) & ~F.col("match") & (F.col("rank") <= 20)) if "match" in graded.columns else F.lit(False)
    own = graded.join(truth, "query_id").where("video_id = true_video").groupBy("query_id").agg(F.min(d).alias("least_distance"), wrong.alias("mismatch"))
    first = graded.groupBy("query_id").agg(F.min(F.when(F.col("r") > 0, F.col("rank"))).alias("first_hit"), F.min(F.when(F.col("r") >= 1, F.col("rank"))).alias("first_perfect"))
    out = r_at_k(graded).join(first, "query_id").join(order, "query_id", "left").join(own, "query_id", "left")
    out = out.withColumn("mrr", F.coalesce(1.0 / F.col("video_rank"), F.lit(0.0)))
    error = error_class(F.col("video_rank"), F.col("first_perfect"), F.col("first_hit"), F.col("least_distance"), F.col("mismatch"))
    return out.withColumn("error", error).drop("mismatch")


def summary(per_query: DataFrame, task: str = "task_type") -> DataFrame:
    """Means per task and over all (task null -> 'all'), with recall of the right video."""
    seen = [F.avg((F.coalesce(F.col("video_rank"), F.lit(1 << 30)) <= k).cast("double")).alias(f"video_r_{k}") for k in (1, 5, 20, 100)]
    out = per_query.rollup(task).agg(F.count("*").alias("n"), F.avg("final").alias("final"), *[F.avg(f"r_{k}").alias(f"r_{k}") for k in DEPTHS], F.avg("mrr").alias("mrr"), *seen)
    return out.withColumn(task, F.coalesce(task, F.lit("all")))


def run_report(per_query: DataFrame, task: str = "task_type") -> DataFrame:
    """What a run is reported by, per task and over all ('all'): mean score, recall of the right video, mean latency."""
    seen = [F.avg((F.coalesce(F.col("video_rank"), F.lit(1 << 30)) <= k).cast("double")).alias(f"video_r_{k}") for k in (1, 5, 20, 100)]
    out = per_query.rollup(task).agg(F.avg("final").alias("score"), *seen, F.avg("latency_ms").alias("latency_ms"))
    return out.withColumn(task, F.coalesce(task, F.lit("all")))
