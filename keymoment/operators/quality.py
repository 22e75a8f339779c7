"""Validation, audits and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_error(line: Column, task: Column) -> Column:
    """The first fault of a submission line, null for a good one. Tasks: kis (video,frame), qa (video,frame,"answer"), trake
    (video,frame,...)."""
    p = F.split(line, ",")
    answer = F.replace(F.regexp_extract(line, r'^[^,]*,[^,]*,"?(.*?)"?$', 1), F.lit('""'), F.lit('"'))
    frames = F.when(task == "trake", F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(1)))).otherwise(F.slice(p, 2, 1))
    number = F.forall(frames, lambda x: F.trim(x).rlike(r"^-?[0-9]+$"))
    return (
        F.when(F.lower(line).startswith("video"), "HEADER")
        .when(F.length(F.trim(p[0])) == 0, "NO_VIDEO")
        .when(F.lower(p[0]).endswith(".mp4"), "EXTENSION")
        .when(((task == "kis") & (F.size(p) != 2)) | ((task == "qa") & (F.size(p) < 3)) | ((task == "trake") & (F.size(p) < 2)), "COLUMNS")
        .when(~number, "FRAME")
        .when(F.exists(frames, lambda x: F.trim(x).startswith("-")), "NEGATIVE")
        .when((task == "qa") & (F.length(F.trim(answer)) == 0), "NO_ANSWER")
        .when((task == "qa") & (F.length(answer) > 100), "LONG_ANSWER")
    )


def validate(lines: DataFrame, most: int = 100) -> DataFrame:
    """Per file of lines(file, row_no, line, task): rows, valid and the first error by row; more than `most` rows are one."""
    bad = lines.withColumn("e", line_error(F.col("line"), F.col("task")))
    out = bad.groupBy("file").agg(F.count("*").alias("rows"), F.min(F.when(F.col("e").isNotNull(), F.struct("row_no", "e"))).alias("first"))
    error = F.when(F.col("rows") > most, "TOO_MANY_ROWS").otherwise(F.col("first.e"))
    return out.select("file", "rows", error.isNull().alias("valid"), F.coalesce(error, F.lit("")).alias("error"))


def validate_folders(files: DataFrame, by: list[str]) -> DataFrame:
    """Per folder of validate()'s files: how many there are, how many are valid, and whether all are."""
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.count_if("valid").alias("valid_files"), F.bool_and("valid").alias("all_valid"))


def readable_boxes(boxes: DataFrame, text: str, least_w: int = 14, least_h: int = 12, least_chars: int = 2) -> DataFrame:
    """Boxes (x1, y1, x2, y2) of text that are large enough to be read, with w and h."""
    sized = boxes.withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    return sized.where((F.col("w") >= least_w) & (F.col("h") >= least_h) & (F.char_length(F.trim(text)) >= least_chars))


def upsert_keep_last(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregate of structs: combined in each task before the shuffle, unlike a window."""
    rest = [c for c in log.columns if c not in key and c not in order]
    return log.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("x")).select(*key, *[f"x.{c}" for c in (*order, *rest)])


def count_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose row counts differ between two tables, with both counts."""
    both = a.select(key, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(key, F.lit(0).alias("x"), F.lit(1).alias("y")))
    return both.groupBy(key).agg(F.sum("x").alias("in_a"), F.sum("y").alias("in_b")).where("in_a <> in_b")


def strictly_increasing(values: Column) -> Column:
    return F.forall(F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), lambda a, b: F.coalesce(a < b, F.lit(True))), lambda x: x)


def merge_batches(batches: list[DataFrame], order: list[str], id_col: str = "global_id") -> DataFrame:
    """One table of several batches with ids numbered anew from 0 in the given order; missing columns are null.

    Ids over a whole table need one total order: rows are range-partitioned by it, counted per partition, and numbered
    within, so that no task gets all rows."""
    every = None
    for i, b in enumerate(batches):
        b = b.drop(id_col).withColumn("batch", F.lit(i))
        every = b if every is None else every.unionByName(b, allowMissingColumns=True)
    parts = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: adaptive execution leaves it
    bounds = every.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    bounds = bounds.withColumn("__k", F.col("__m") - F.shiftleft(F.col("__p").cast("bigint"), 33))
    counts = bounds.groupBy("__p").agg(F.count("*").alias("c"))
    ahead = counts.select("__p", F.coalesce(F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("a"))
    return bounds.join(F.broadcast(ahead), "__p").withColumn(id_col, F.col("a") + F.col("__k")).drop("__p", "__m", "__k", "a")  # one row a partition


def override(rows: DataFrame, chosen: DataFrame, first: bool = True, most: int = 100) -> DataFrame:
    """rows(query_id, rank, video_id, frame_idx) with chosen rows first (or last), repeats of them dropped, ranked anew."""
    rest = rows.join(chosen.select("query_id", "video_id", "frame_idx"), ["query_id", "video_id", "frame_idx"], "left_anti").withColumn("o", F.lit(1))
    every = rest.unionByName(chosen.withColumn("o", F.lit(0 if first else 2)))
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "rank"))).where(F.col("rank") <= most).drop("o")


def object_summary(detections: DataFrame, persons: list[str], low: float = 0.3, high: float = 0.7, top: int = 5) -> DataFrame:
    """Per frame: person_count (score over low), the most counted entities, and those with a score over high, comma-joined."""
    each = detections.groupBy("global_id", "entity").agg(F.count("*").alias("c"), F.count_if(F.col("score") > low).alias("sure"), F.max("score").alias("best"))
    out = each.groupBy("global_id").agg(
        F.coalesce(F.sum(F.when(F.col("entity").isin(*persons), F.col("sure"))), F.lit(0)).alias("person_count"),
        F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "entity"))).alias("all"),
        F.sort_array(F.collect_set(F.when(F.col("best") > high, F.col("entity")))).alias("high"),
    )  # entities of one frame: as many as kinds of entities
    return out.select("global_id", "person_count", F.array_join(F.transform(F.slice("all", 1, top), lambda x: x["entity"]), ",").alias("top_entities"), F.array_join("high", ",").alias("high_conf_entities"))
