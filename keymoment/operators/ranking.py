"""Diversification and completion of ranked lists (query_id, rank, video_id, frame_idx, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by(q: str = "query_id"):
    return Window.partitionBy(q)


def dedup_window(rows: DataFrame, k: int, width: int = 50) -> DataFrame:
    """The first row of each (video, frame // width) in rank order, then the skipped ones, up to k."""
    seen = F.row_number().over(Window.partitionBy("query_id", "video_id", F.floor(F.col("frame_idx") / width)).orderBy("rank"))
    rows = rows.withColumn("late", (seen > 1).cast("int"))
    return rows.withColumn("place", F.row_number().over(_by().orderBy("late", "rank"))).where(F.col("place") <= k).drop("late")


def video_order(rows: DataFrame) -> DataFrame:
    """(query_id, video_id, best_rank, video_rank): videos in the order in which they first come."""
    first = rows.groupBy("query_id", "video_id").agg(F.min("rank").alias("best_rank"))
    return first.withColumn("video_rank", F.row_number().over(_by().orderBy("best_rank")))


def spread_per_video(rows: DataFrame, frames: DataFrame, k: int, videos: int = 10) -> DataFrame:
    """Of the first videos each its keyframes nearest to its best frame, max(4, k // videos found) of them, in order; then the
    rows that aren't among them, by rank, up to k."""
    order = video_order(rows).where(F.col("video_rank") <= videos)
    order = order.withColumn("each", F.greatest(F.lit(4), F.floor(F.lit(k) / F.count("*").over(_by()))))
    best = order.join(rows.select("query_id", "video_id", F.col("rank").alias("best_rank"), F.col("frame_idx").alias("best")), ["query_id", "video_id", "best_rank"])
    near = best.join(frames.select("video_id", "frame_idx"), "video_id").withColumn("d", F.abs(F.col("frame_idx") - F.col("best")))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy("d", "frame_idx"))).where(F.col("r") <= F.col("each"))
    near = near.select("query_id", "video_id", "frame_idx", F.col("video_rank").cast("bigint").alias("a"), F.col("r").cast("bigint").alias("b"))
    every = near.unionByName(rows.select("query_id", "video_id", "frame_idx", F.lit(1 << 40).alias("a"), F.col("rank").cast("bigint").alias("b")))
    every = every.groupBy("query_id", "video_id", "frame_idx").agg(F.min(F.struct("a", "b")).alias("o"))
    return every.withColumn("place", F.row_number().over(_by().orderBy("o"))).where(F.col("place") <= k).select("query_id", "place", "video_id", "frame_idx")


def dedup_sequence(rows: DataFrame, events: str = "events") -> DataFrame:
    w = Window.partitionBy("query_id", "video_id", events).orderBy("rank")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def pad_to(rows: DataFrame, k: int, n: int = 3) -> DataFrame:
    """Rows up to k for each query: the missing ones at frames 100 * (place - 1) + 400 * i of the top video."""
    top = rows.groupBy("query_id").agg(F.count("*").alias("had"), F.min_by("video_id", "rank").alias("video_id"))
    more = top.where(F.col("had") < k).withColumn("rank", F.explode(F.sequence(F.col("had") + 1, F.lit(k).cast("bigint"))))
    events = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.col("rank") - 1) * 100 + i * 400)
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), "video_id", "events").unionByName(more.select("query_id", "rank", "video_id", events.alias("events")))


def promote(rows: DataFrame, winner) -> DataFrame:
    """The best row for which winner holds comes first with the top score plus 0.1; the others keep their order."""
    mark = F.min(F.when(winner, F.col("rank"))).over(_by())
    rows = rows.withColumn("won", F.coalesce((F.col("rank") == mark).cast("int"), F.lit(0)))
    score = F.when(F.col("won") == 1, F.max("s").over(_by()) + 0.1).otherwise(F.col("s"))
    return rows.withColumn("score", score).withColumn("place", F.row_number().over(_by().orderBy(F.desc("won"), "rank"))).drop("won")


def top_up(found: DataFrame, wider: DataFrame, k: int) -> DataFrame:
    """Videos found (video_id, rank) and, if fewer than k, further ones from a wider list."""
    more = wider.join(found.select("video_id"), "video_id", "left_anti").withColumn("late", F.lit(1))
    every = found.withColumn("late", F.lit(0)).unionByName(more)
    return every.withColumn("place", F.row_number().over(Window.orderBy("late", "rank", "video_id"))).where(F.col("place") <= k).drop("late")


def aggregate_videos(rows: DataFrame, per_video: int, videos: int) -> DataFrame:
    """Frames (video_id, global_id, s, coverage) of the best videos: by largest coverage then score of their best frames."""
    order = [F.desc("coverage"), F.desc("s"), F.col("global_id")]
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy(*order))).where(F.col("r") <= per_video)
    top = best.groupBy("video_id").agg(F.max("coverage").alias("v_coverage"), F.max("s").alias("v_score")).orderBy(F.desc("v_coverage"), F.desc("v_score"), "video_id").limit(videos)
    return best.join(F.broadcast(top), "video_id")  # at most `videos` rows


def diverse_hypotheses(frames: DataFrame, k: int = 100, apart_ms: int = 8000) -> DataFrame:
    """The first k frames (video_id, pts_ms, frame_idx, global_id, s) of each video, hedged over moments: the best one, the
    best near it, the best at least apart_ms away from the first, the second best near the first, the best near the second,
    then all others by score. Each pick is an aggregate, so no task takes more of a video than its ordering at the end."""
    rows = frames.select("video_id", "pts_ms", "frame_idx", "global_id", "s")
    key = F.struct("s", (-F.col("global_id")).alias("o"), "pts_ms", "global_id")

    def best(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("video_id").agg(F.max(key).alias(name))

    one = rows.join(best(rows, "b1"), "video_id")
    away = F.abs(F.col("pts_ms") - F.col("b1.pts_ms"))
    near = best(one.where((away > 0) & (away <= apart_ms)), "n1")
    two = best(one.where(away >= apart_ms), "b2")
    marked = one.join(near, "video_id", "left").join(two, "video_id", "left")
    off = F.abs(F.col("pts_ms") - F.col("b2.pts_ms"))
    again = best(marked.where((away > 0) & (away <= apart_ms) & (F.col("global_id") != F.col("n1.global_id"))), "n1b")
    other = best(marked.where((off > 0) & (off <= apart_ms)), "n2")
    marked = marked.join(again, "video_id", "left").join(other, "video_id", "left")
    place = F.lit(6)
    for i, name in reversed(list(enumerate(("b1", "n1", "b2", "n1b", "n2"), 1))):
        place = F.when(F.col("global_id") == F.col(f"{name}.global_id"), i).otherwise(place)
    order = Window.partitionBy("video_id").orderBy("o", F.desc("s"), "global_id")
    out = marked.withColumn("o", place).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return out.select("video_id", "place", "frame_idx", "global_id", "s")
