"""Alignment of ordered events to frames, as window algebra: no UDF, one partitioning by video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Gap (ms) without penalty and penalty per second beyond it.
FREE_MS, PENALTY = 240_000, 0.001


def monotonic_dp(events: DataFrame, n: int, free_ms: int = FREE_MS, penalty: float = PENALTY) -> DataFrame:
    """(video_id, total, path) of the best strictly increasing choice of a frame for each of n events.

    events has video_id, pts_ms, frame_idx and scores e1..en. dp of event i at a frame is its score plus the best dp of
    event i - 1 at an earlier frame less the penalty of the gap. The penalty is flat up to free_ms and linear beyond, so
    the best predecessor is the greater of two range-window maxima; each carries its path along. Earlier frames win ties.
    Videos without a feasible choice are left out.
    """
    w = Window.partitionBy("video_id").orderBy("pts_ms")
    t = F.col("pts_ms") / 1000.0
    step = events.withColumn("dp", F.col("e1")).withColumn("path", F.array("frame_idx"))
    for i in range(2, n + 1):
        near = F.max(F.when(F.col("dp").isNotNull(), F.struct(F.col("dp").alias("v"), (-F.col("pts_ms")).alias("o"), F.col("path").alias("p")))).over(w.rangeBetween(-free_ms, -1))
        lifted = F.struct((F.col("dp") + penalty * t).alias("v"), (-F.col("pts_ms")).alias("o"), F.col("path").alias("p"))
        far = F.max(F.when(F.col("dp").isNotNull(), lifted)).over(w.rangeBetween(Window.unboundedPreceding, -free_ms - 1))
        step = step.withColumn("near", near).withColumn("far", far)
        v1, v2 = F.col("near.v"), F.col("far.v") - penalty * (t - free_ms / 1000.0)
        best = F.greatest(v1, v2)
        path = F.when(v2.isNull() | (v1 > v2) | ((v1 == v2) & (F.col("near.o") > F.col("far.o"))), F.col("near.p")).otherwise(F.col("far.p"))
        step = step.withColumn("path", F.when(best.isNotNull(), F.concat(path, F.array("frame_idx")))).withColumn("dp", best + F.col(f"e{i}")).drop("near", "far")
    done = step.where(F.col("dp").isNotNull())
    best = F.max(F.struct(F.col("dp").alias("v"), (-F.col("pts_ms")).alias("o"), F.col("path").alias("p"))).alias("b")
    return done.groupBy("video_id").agg(best).select("video_id", F.col("b.v").alias("total"), F.col("b.p").cast("array<bigint>").alias("path")).unionByName(_too_short(events, n))


def _too_short(events: DataFrame, n: int) -> DataFrame:
    """What videos of fewer frames than events get; the frames that are gathered are fewer than n."""
    few = events.groupBy("video_id").agg(F.count("*").alias("c")).where(F.col("c") < n).select("video_id")
    own = events.join(few, "video_id").groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("pts_ms", "frame_idx"))).alias("f"))
    frames = F.transform("f", lambda x: x["frame_idx"].cast("bigint"))
    return own.select("video_id", F.lit(None).cast("double").alias("total"), F.slice(F.concat(frames, F.array_repeat(F.element_at(frames, -1), n)), 1, n).alias("path"))


def segmental_dp(events: DataFrame, n: int, longest: int = 5, length_cost: float = 0.02, free_ms: int = FREE_MS, penalty: float = PENALTY) -> DataFrame:
    """(video_id, total, path) where each event takes a run of up to `longest` frames: the mean of its scores less length_cost
    for each frame after the first, runs strictly in order, gaps (end to next start) penalised as in monotonic_dp. path has
    for each event the frame in the middle of its run, the earlier of two. Of equal totals, earlier frames win. Videos of
    fewer frames than events, which have no runs, take their frames in order, the last one again, and total is null."""
    order = Window.partitionBy("video_id").orderBy("pts_ms")
    state = events.withColumn("k", F.row_number().over(order))
    for i in range(1, n + 1):
        state = state.withColumn(f"c{i}", F.sum(f"e{i}").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = F.col("pts_ms") / 1000.0
    none = F.array().cast("array<bigint>")
    for i in range(1, n + 1):
        if i == 1:
            now = state.withColumn("into", F.struct(F.lit(0.0).alias("v"), F.lit(0).cast("bigint").alias("o"), none.alias("p")))
        else:
            of = lambda v: F.when(F.col("dp").isNotNull(), F.struct(v.alias("v"), (-F.col("pts_ms")).alias("o"), F.col("path").alias("p")))
            now = state.withColumn("near", F.max(of(F.col("dp"))).over(order.rangeBetween(-free_ms, -1))).withColumn("far", F.max(of(F.col("dp") + penalty * t)).over(order.rangeBetween(Window.unboundedPreceding, -free_ms - 1)))
            far = F.col("far.v") - penalty * (t - free_ms / 1000.0)
            later = F.col("near.v").isNull() | (far >= F.col("near.v"))  # the far one is the earlier one
            now = now.withColumn("into", F.when(F.col("far").isNotNull() & later, F.struct(far.alias("v"), F.col("far.o").alias("o"), F.col("far.p").alias("p"))).otherwise(F.col("near"))).drop("near", "far")
        # A run that starts `back` frames before its end comes from the predecessor of its start; longer ones win ties.
        runs = []
        for back in range(longest):
            lagged = F.lag("into", back).over(order) if back else F.col("into")
            before = F.coalesce(F.lag(f"c{i}", back + 1).over(order), F.lit(0.0))
            middle = F.lag("frame_idx", back - back // 2).over(order) if back else F.col("frame_idx")
            score = lagged["v"] + (F.col(f"c{i}") - before) / (back + 1) - length_cost * back
            runs.append(F.when((F.col("k") > back) & lagged.isNotNull(), F.struct(score.alias("v"), F.lit(back).alias("o"), F.concat(lagged["p"], F.array(middle.cast("bigint"))).alias("p"))))
        now = now.withColumn("best", F.greatest(*runs))
        state = now.withColumn("dp", F.col("best.v")).withColumn("path", F.col("best.p")).drop("into", "best")
    best = F.max(F.struct(F.col("dp").alias("v"), (-F.col("pts_ms")).alias("o"), F.col("path").alias("p"))).alias("b")
    long = state.where(F.col("dp").isNotNull()).groupBy("video_id").agg(best).select("video_id", F.col("b.v").alias("total"), F.col("b.p").alias("path"))
    return long.unionByName(_too_short(events, n))


def nms_peaks(frames: DataFrame, k: int = 3, reach_ms: int = 2000, score: str = "s") -> DataFrame:
    """(video_id, p1..pk): greedy peaks, those within reach of an earlier peak being suppressed; the last repeats."""
    left = frames.select("video_id", "pts_ms", F.col(score).alias("v"))
    out = None
    for i in range(1, k + 1):
        best = left.groupBy("video_id").agg(F.max(F.struct("v", (-F.col("pts_ms")).alias("o"))).alias("b")).select("video_id", F.col("b.v").alias(f"p{i}"), (-F.col("b.o")).alias("at"))
        found = best.select("video_id", f"p{i}")
        out = found if out is None else out.join(found, "video_id", "left").withColumn(f"p{i}", F.coalesce(f"p{i}", f"p{i - 1}"))
        left = left.join(best, "video_id").where(F.abs(F.col("pts_ms") - F.col("at")) > reach_ms).select("video_id", "pts_ms", "v")
    return out


def coverage_score(calibrated: DataFrame, top: DataFrame) -> DataFrame:
    """0.40 mean + 0.30 soft minimum of calibrated event scores(video_id, p) + 0.30 of the video's global score."""
    soft = -0.2 * F.log(F.sum(F.exp(-5.0 * F.col("p"))) + 1e-6)
    return calibrated.groupBy("video_id").agg(F.avg("p").alias("mean_p"), soft.alias("soft_min")).join(top, "video_id").withColumn("coverage", 0.4 * F.col("mean_p") + 0.3 * F.col("soft_min") + 0.3 * F.col("top_mean"))
