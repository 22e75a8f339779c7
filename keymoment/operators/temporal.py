"""Windows over time and joins by time, per video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbor_max(hits: DataFrame, reach_ms: int = 30_000, score: str = "s", by: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Adds neighbor: the best score of other hits of the video within reach, or the hit's own without any. Hits at the
    same time aren't each other's neighbours."""
    w = Window.partitionBy(*by).orderBy("pts_ms")
    around = F.greatest(F.max(score).over(w.rangeBetween(-reach_ms, -1)), F.max(score).over(w.rangeBetween(1, reach_ms)))
    return hits.withColumn("neighbor", F.coalesce(around, F.col(score)))


def gaussian_smooth(frames: DataFrame, sigma_s: float = 1.5, reach: float = 6.0, score: str = "s") -> DataFrame:
    """(video_id, global_id, smooth): the Gaussian-weighted mean over frames of the video within reach * sigma.

    Beyond six sigma a weight is under 2e-8, so the cut doesn't show in six digits; it makes the join one by time, which
    buckets of that width serve: each frame meets those of its own and the two adjacent buckets."""
    width = int(max(1, reach * sigma_s * 1000))
    a = frames.select("video_id", "global_id", F.col("pts_ms").alias("t"), F.explode(F.array(*[F.floor(F.col("pts_ms") / width) + i for i in (-1, 0, 1)])).alias("b"))
    b = frames.select("video_id", F.col("pts_ms").alias("u"), F.col(score).alias("v"), F.floor(F.col("pts_ms") / width).alias("b"))
    d = (F.col("t") - F.col("u")) / 1000.0
    w = F.exp(-(d * d) / (2 * sigma_s * sigma_s))
    near = a.join(b, ["video_id", "b"]).where(F.abs(F.col("t") - F.col("u")) <= width)
    return near.groupBy("video_id", "global_id").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("smooth"))


def three_point_smooth(frames: DataFrame, score: str = "s", by: tuple[str, ...] = ("video_id",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("pts_ms")
    s = F.col(score)
    return frames.withColumn("smooth", 0.2 * F.coalesce(F.lag(score).over(w), s) + 0.6 * s + 0.2 * F.coalesce(F.lead(score).over(w), s))


def minmax_norm(rows: DataFrame, score: str, by: tuple[str, ...], name: str = "norm", flat: str = "keep") -> DataFrame:
    """Min-max over groups. A group of span up to 1e-6 keeps its values (flat="keep") or divides by 1 (flat="one")."""
    w = Window.partitionBy(*by)
    low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    same = F.col(score) if flat == "keep" else F.col(score) - low
    return rows.withColumn(name, F.when(span > 1e-6, (F.col(score) - low) / span).otherwise(same))


def window_coverage(frames: DataFrame, cues: list[str], reach_ms: int = 6000) -> DataFrame:
    """Adds coverage: the mean over cue columns of each one's best value within reach."""
    w = Window.partitionBy("video_id").orderBy("pts_ms").rangeBetween(-reach_ms, reach_ms)
    total = F.lit(0.0)
    for c in cues:
        total = total + F.max(c).over(w)
    return frames.withColumn("coverage", total / len(cues))


def keyframe_gap(frames: DataFrame, large: int = 75) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    gap = F.greatest(F.coalesce(F.col("frame_idx") - F.lag("frame_idx").over(w), F.lit(0)), F.coalesce(F.lead("frame_idx").over(w) - F.col("frame_idx"), F.lit(0)))
    return frames.withColumn("gap", gap).withColumn("large", F.col("gap") >= large)


def _across(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """(video_id, b, prior, later) of rows in buckets b: the greatest hi of the video's earlier buckets, the least lo of its
    later ones. A bucket is one row here, so a video's order is one of buckets, and its rows meet in their bucket alone."""
    ends = rows.groupBy("video_id", "b").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    back = Window.unboundedPreceding, -1
    prior = F.max("hi").over(Window.partitionBy("video_id").orderBy("b").rowsBetween(*back))
    later = F.min("lo").over(Window.partitionBy("video_id").orderBy(F.desc("b")).rowsBetween(*back))
    return ends.select("video_id", "b", prior.alias("prior"), later.alias("later"))


def gap_around(frames: DataFrame, at: DataFrame, large: int = 75, unknown: int = 100, fps: float = 25.0, bucket: int = 15_000) -> DataFrame:
    """For each (video_id, target) the greater distance of a frame number to the keyframes before and after the first one that
    isn't under it (at the ends, to the first or last itself), in frames and seconds, and whether it is large. Videos of
    fewer than two keyframes, or none, have an unknown gap, which counts as large.

    Keyframes and targets are put in one order per video and bucket of frame numbers, and what lies before and after carried
    over; no pairs are made. Frames that run up to the end are taken in descending order: Spark goes through all that is
    left of a window for each row of one that ends unbounded."""
    keys = frames.where("video_id IS NOT NULL AND frame_idx IS NOT NULL").select("video_id", F.col("frame_idx").cast("bigint").alias("x"), F.floor(F.col("frame_idx") / bucket).alias("b"))
    w = Window.partitionBy("video_id", "b").orderBy("x")
    keys = keys.withColumns({"lag": F.lag("x").over(w), "lead": F.lead("x").over(w)}).join(_across(keys, F.col("x"), F.col("x")), ["video_id", "b"])
    mark = F.struct("x", F.coalesce("lag", "prior", "x").alias("lo"), F.coalesce("lead", "later", "x").alias("hi"))
    marks = keys.select("video_id", "b", "x", mark.alias("mark"))
    x = F.col("target").cast("bigint")
    both = at.select("video_id", F.floor(x / bucket).alias("b"), x.alias("x"), F.lit(None).cast(marks.schema["mark"].dataType).alias("mark")).unionByName(marks)
    # Of keyframes of one number, the first in order has the least mark.
    after = F.min("mark").over(Window.partitionBy("video_id", "b").orderBy(F.desc("x")))
    own = both.withColumn("after", after).where("mark IS NULL").join(_across(both, F.col("mark"), F.col("mark")).select("video_id", "b", "later"), ["video_id", "b"], "left")
    own = own.join(marks.groupBy("video_id").agg(F.count("*").alias("n"), F.max("mark").alias("end")), "video_id", "left")
    around = F.coalesce("after", "later", "end")
    gap = F.when(F.col("n") >= 2, F.greatest(F.col("x") - around["lo"], around["hi"] - F.col("x"))).otherwise(F.lit(unknown).cast("bigint"))
    out = own.select("video_id", F.col("x").alias("target"), gap.alias("gap"), F.coalesce(F.col("n") < 2, F.lit(True)).alias("few"))
    return out.select("video_id", "target", "gap", (F.col("gap") / fps).alias("seconds"), (F.col("few") | (F.col("gap") >= large)).alias("large"))


def surrounding(frames: DataFrame, at: DataFrame, count: int = 5) -> DataFrame:
    """For each (video_id, position) of at, count keyframes around it, moved inwards at the edges."""
    last = frames.groupBy("video_id").agg(F.max("keyframe_index").alias("last"))
    first = F.greatest(F.lit(1), F.least(F.col("position") - count // 2, F.col("last") - count + 1))
    span = at.join(last, "video_id").withColumn("first", first)
    return span.join(frames, "video_id").where(F.col("keyframe_index").between(F.col("first"), F.col("first") + count - 1))


def dedup_adjacent(pieces: Column) -> Column:
    """The pieces of an array without those equal (without case) to the one before."""
    return F.filter(pieces, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.element_at(pieces, F.greatest(i, F.lit(1))))))


def points_in_intervals(frames: DataFrame, spans: DataFrame, slack_ms: int = 0, bucket_ms: int = 60_000) -> DataFrame:
    """Frames with the segments of their video that hold them, slack on both sides. The join is by video and time bucket,
    so that a long video is many keys; a segment goes to each bucket that it touches."""
    f = frames.withColumn("b", F.floor(F.col("pts_ms") / bucket_ms))
    lo, hi = F.floor((F.col("start_ms") - slack_ms) / bucket_ms), F.floor((F.col("end_ms") + slack_ms) / bucket_ms)
    s = spans.withColumn("b", F.explode(F.sequence(lo, hi)))
    return f.join(s, ["video_id", "b"]).where((F.col("pts_ms") >= F.col("start_ms") - slack_ms) & (F.col("pts_ms") <= F.col("end_ms") + slack_ms)).drop("b")


def overlapping(spans: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return spans.where((F.col("start_ms") <= end_ms) & (F.col("end_ms") >= start_ms))


def nearest_segment(frames: DataFrame, spans: DataFrame, bucket_ms: int = 600_000) -> DataFrame:
    """As-of join both ways: for each frame the segment of its video whose start is nearest, the earlier on a tie. global_id
    may be of any type.

    Frames and starts are put in one order per video and time bucket and the last start before and first start after carried
    over, from other buckets by their ends: no pairs are made, no task gets a whole video, and no window ends unbounded,
    for which Spark would go through the rest of the video for each row."""
    starts = spans.where("video_id IS NOT NULL").select("video_id", F.col("start_ms").cast("bigint").alias("t"), F.lit(None).cast(frames.schema["global_id"].dataType).alias("global_id"), F.lit(0).alias("kind"), F.col("start_ms").cast("bigint").alias("start"))
    both = frames.select("video_id", F.col("pts_ms").alias("t"), "global_id", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("start")).unionByName(starts).withColumn("b", F.floor(F.col("t") / bucket_ms))
    by = Window.partitionBy("video_id", "b")
    own = both.withColumn("before", F.max("start").over(by.orderBy("t"))).withColumn("after", F.min("start").over(by.orderBy(F.desc("t")))).where("kind = 1")
    own = own.join(_across(both, F.col("start"), F.col("start")), ["video_id", "b"], "left")
    before, after = F.coalesce("before", "prior"), F.coalesce("after", "later")
    d1, d2 = F.col("t") - before, after - F.col("t")
    near = F.when(after.isNull() | (d1 <= d2), before).otherwise(F.coalesce(after, before))
    return own.select("video_id", "global_id", F.col("t").alias("pts_ms"), F.when(F.col("t").isNotNull(), near).alias("start_ms"))


def nearest_frame(frames: DataFrame, at: DataFrame, column: str = "frame_idx") -> DataFrame:
    """For each (video_id, target) the frame nearest by a column, the first on a tie."""
    d = F.abs(F.col(column) - F.col("target"))
    return at.join(frames, "video_id").groupBy("video_id", "target").agg(F.min_by("frame_idx", F.struct(d.alias("d"), F.col("frame_idx").alias("f"))).alias("nearest"))
