"""Fusion of ranked lists and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF = 60


def wrrf(lists: dict[str, tuple[DataFrame, float]], key: list[str]) -> DataFrame:
    """Weighted reciprocal rank fusion: the sum of weight / (60 + rank) over lists(key, rank); by union and aggregate, which
    merges as a full outer join would but with partial sums. Lists of weight 0 are left out of the plan."""
    parts = [df.select(*key, (F.lit(w) / (RRF + F.col("rank"))).alias("p"), F.lit(i).alias("list")) for i, (df, w) in enumerate(lists.values()) if w > 0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*key).agg(F.sum("p").alias("fused"), F.min("list").alias("first_list"), F.count("*").alias("lists"))


def max_normalised(scores: DataFrame, score: str = "score", name: str = "norm") -> DataFrame:
    """Scores over their global maximum; over 1 if that is under 1e-6."""
    top = scores.agg(F.max(score).alias("top"))
    top = top.select(F.when(F.coalesce("top", F.lit(0.0)) < 1e-6, 1.0).otherwise(F.col("top")).alias("top"))
    return scores.join(F.broadcast(top)).withColumn(name, F.col(score) / F.col("top")).drop("top")  # one row


def lexical_support(hits: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Best normalised score per frame and per video of hits(video_id, global_id, norm)."""
    frame = hits.groupBy("global_id").agg(F.max("norm").alias(f"{name}_frame"))
    return frame, hits.groupBy("video_id").agg(F.max("norm").alias(f"{name}_video"))


def tnca_score(pool: DataFrame, transition: bool | Column, lexical: list[str] = (), neighbour: bool = True) -> DataFrame:
    """s + weight * neighbor + s * bonus; bonus 0.15 for each lexical signal over 0.1, the signal being the greater of the
    frame's and 0.8 times the video's."""
    s = F.col("s")
    total = s + (F.when(F.lit(transition) if isinstance(transition, bool) else transition, 0.15).otherwise(0.075) * F.col("neighbor") if neighbour else F.lit(0.0))
    for name in lexical:
        signal = F.greatest(F.coalesce(f"{name}_frame", F.lit(0.0)), 0.8 * F.coalesce(f"{name}_video", F.lit(0.0)))
        total = total + s * F.when(signal > 0.1, 0.15 * signal).otherwise(0.0)
    return pool.withColumn("final", total)


def intra_video(rows: DataFrame, signals: dict[str, float], objects: str | None = None, weights: tuple[float, float, float] = (0.55, 0.25, 0.20), without: tuple[float, float] = (0.65, 0.35)) -> DataFrame:
    """Adds final to frames with s, smooth and, if there are cues, coverage: their weighted sum, and a bonus for each signal
    (column -> weight) of a modality that the query calls for; objects weigh 0.10 in videos that have any of note."""
    a, b, c = weights
    final = a * F.col("s") + b * F.col("smooth") + c * F.col("coverage") if "coverage" in rows.columns else without[0] * F.col("s") + without[1] * F.col("smooth")
    for name, w in signals.items():
        final = final + w * F.coalesce(name, F.lit(0.0))
    if objects:
        some = F.max(F.coalesce(objects, F.lit(0.0))).over(Window.partitionBy("video_id")) > 0
        final = final + F.when(some, 0.10 * F.coalesce(objects, F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("final", final)


def rerank(base: DataFrame, scored: DataFrame, factor: float = 0.4) -> DataFrame:
    """(global_id, reranked): base frames with s + factor * (final - raw) where scored(global_id, final, raw) has them; the
    other frames of scored, those of candidate videos, come with their final score."""
    both = base.select("global_id", "s").join(scored, "global_id", "full_outer")
    moved = F.col("s") + F.coalesce(factor * (F.col("final") - F.col("raw")), F.lit(0.0))
    return both.select("global_id", F.when(F.col("s").isNull(), F.col("final")).otherwise(moved).alias("reranked"))


def propagate_answer(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """The first answer by rank fills rows that have none."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(answer, F.coalesce(F.col(answer), F.first(answer, ignorenulls=True).over(w)))
