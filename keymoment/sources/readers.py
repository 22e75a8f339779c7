"""Readers and writers of the raw formats: keyframe maps, media information, detections, vectors, queries, submissions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_optional(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A Parquet table with the given columns (name -> type): missing ones are 0 or empty, null texts empty."""
    df = spark.read.parquet(path)
    out = []
    for name, kind in columns.items():
        empty = F.lit("") if kind == "string" else F.lit(0)
        out.append((F.coalesce(F.col(name), empty) if name in df.columns and kind == "string" else F.col(name) if name in df.columns else empty).cast(kind).alias(name))
    return df.select(*out)


#: Members that are handed on together: so many, or of so many bytes, at most but for one longer than that.
_MANY, _LONG = 1000, 4 << 20


def _members(suffix: str):
    def named(path: str, data: bytes) -> Iterator[tuple[str, str]]:
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for name in sorted(z.namelist()):
                    if name.lower().endswith(suffix):
                        yield name, z.read(name).decode("utf-8", "replace")
        elif path.lower().endswith(suffix):
            yield path, data.decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, size = [], [], 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, text in named(path, content.as_buffer().to_pybytes()):
                    if names and (len(names) >= _MANY or size + len(text) > _LONG):
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts)], ["name", "text"])
                        names, texts, size = [], [], 0
                    names.append(name)
                    texts.append(text)
                    size += len(text)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts)], ["name", "text"])

    return run


def read_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(name, text) of the files under path that end in suffix, and of those within zip files there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(_members(suffix), "name string, text string")


def read_keyframe_maps(spark: SparkSession, path: str, lengths: DataFrame | None = None) -> DataFrame:
    """CSV files (n, pts_time, fps, frame_idx), plain or in zip files, one a video, named after it; global_id numbers rows by
    video and n, clip_row from 0 within the video. With lengths(video_id, length) rows have position_ratio, the share of the
    video before them, 1 at most.

    Ids come from row counts per video, summed over videos, and the place within: only the list of videos is ordered
    in one task."""
    lines = read_members(spark, path, ".csv").select(stem(F.col("name")).alias("video_id"), F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    row = F.from_csv("line", "n int, pts_time double, fps double, frame_idx int")
    rows = lines.where((F.col("i") > 0) & (F.length(F.trim("line")) > 0)).select("video_id", row.alias("r")).select("video_id", "r.*")
    counts = rows.groupBy("video_id").agg(F.count("*").alias("c"))
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("c").over(Window.orderBy("video_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("video_id", "ahead")
    rows = rows.join(ahead, "video_id").withColumn("keyframe_index", F.col("n"))
    rows = rows.withColumn("clip_row", F.row_number().over(Window.partitionBy("video_id").orderBy("n")) - 1)
    rows = rows.withColumn("global_id", F.col("ahead") + F.col("clip_row")).drop("ahead", "n")
    if lengths is None:
        return rows
    whole = F.when(F.coalesce("length", F.lit(0.0)) == 0, 1.0).otherwise(F.col("length"))
    return rows.join(lengths.select("video_id", "length"), "video_id", "left").withColumn("position_ratio", F.least(F.lit(1.0), F.col("pts_time") / whole)).drop("length")


def read_media_info(spark: SparkSession, path: str) -> DataFrame:
    """JSON files, plain or in zip files, one a video, with defaults for missing fields, and search_text of title,
    description and keywords."""
    schema = "author string, title string, description string, keywords array<string>, length double, publish_date string"
    j = read_members(spark, path, ".json").select(stem(F.col("name")).alias("video_id"), F.from_json("text", schema).alias("j")).select("video_id", "j.*")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("author", "title", "description", "publish_date")]
    j = j.select("video_id", *text, F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("length", F.lit(0.0)).alias("length"))
    return j.withColumn("search_text", F.lower(F.concat_ws(" ", "title", "description", F.array_join("keywords", " "))))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """JSON files, plain or in zip files, one a frame in a folder a video, of five parallel arrays; a row for each detection."""
    schema = "detection_scores array<string>, detection_class_names array<string>, detection_class_entities array<string>, detection_boxes array<array<string>>, detection_class_labels array<string>"
    j = read_members(spark, path, ".json").select("name", F.from_json("text", schema).alias("j")).select("name", "j.*")
    x = j.select(F.element_at(F.split("name", "/"), -2).alias("video_id"), stem(F.col("name")).cast("int").alias("keyframe_index"), F.posexplode(F.arrays_zip("detection_scores", "detection_class_names", "detection_class_entities", "detection_boxes", "detection_class_labels")).alias("detection_rank", "d"))
    return x.select("video_id", "keyframe_index", "detection_rank", F.col("d.detection_class_entities").alias("entity"), F.col("d.detection_class_names").alias("class_name"), F.col("d.detection_class_labels").cast("int").alias("class_label"), F.col("d.detection_scores").cast("double").alias("score"), *[F.col("d.detection_boxes")[i].cast("double").alias(f"bbox_{i}") for i in range(4)])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            m = np.load(io.BytesIO(content.as_buffer().to_pybytes()), allow_pickle=False).astype(np.float32)
            name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            for start in range(0, len(m), 4096):
                part = m[start : start + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(start, start + len(part)), pa.int32()), pa.array(list(part), pa.list_(pa.float32()))], ["video_id", "row", "embedding"])


def read_npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, row, embedding) of .npy files, one a video; keyed, so that no later step goes by position."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_vectors, "video_id string, row int, embedding array<float>")


def read_query_texts(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, task_type, text) of .txt files; the task is in the name."""
    t = spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("query_id"), F.trim("value").alias("text"))
    low = F.lower("query_id")
    return t.withColumn("task_type", F.when(low.contains("trake"), "trake").when(low.contains("qa") | low.contains("q&a"), "qa").otherwise("kis"))


def read_query_json(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, task_type, text) of JSON: an object with test_cases, a list, or one object. An id without its task gets it
    as a suffix."""
    case = "struct<query_id:string,task_type:string,query_text:string>"
    raw = spark.read.text(path, wholetext=True)
    many = F.coalesce(F.from_json("value", f"struct<test_cases:array<{case}>>")["test_cases"], F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{case}>")), F.array(F.from_json("value", case)))
    q = raw.select(F.explode(many).alias("q")).select("q.*")
    task = F.lower(F.coalesce("task_type", F.lit("kis")))
    named = F.lower("query_id").rlike("kis|qa|trake")
    return q.select(F.when(named, F.col("query_id")).otherwise(F.concat("query_id", F.lit("-"), task)).alias("query_id"), task.alias("task_type"), F.col("query_text").alias("text"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, line) of ragged CSV without header; blank rows are skipped. row_no follows the order in the file."""
    t = spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("row_no", "line"))
    return t.where(F.length(F.trim("line")) > 0)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file without comments (#) and blanks."""
    t = spark.read.text(path).select(F.trim("value").alias("url"))
    return t.where((F.length("url") > 0) & ~F.col("url").startswith("#"))


def write_partitioned(df: DataFrame, path: str, video: str = "video_id") -> None:
    """A folder for each prefix of video ids, so that later scans of some videos read their folders alone."""
    df.withColumn("prefix", F.substring_index(F.col(video), "_", 1)).write.mode("overwrite").partitionBy("prefix").parquet(path)


def submission_lines(rows: DataFrame) -> DataFrame:
    """(query_id, rank, line): kis video,frame; qa with a quoted answer of up to 100 characters; trake video,f1..fN.
    rows has query_id, rank, task_type, video_id, frames and answer."""
    video = F.regexp_replace("video_id", r"(?i)\.mp4$", "")
    plain = F.concat_ws(",", video, F.array_join(F.col("frames").cast("array<string>"), ","))
    answer = F.regexp_replace(F.substring(F.trim(F.coalesce("answer", F.lit(""))), 1, 100), '"', '""')
    return rows.select("query_id", "rank", F.when(F.col("task_type") == "qa", F.concat(plain, F.lit(',"'), answer, F.lit('"'))).otherwise(plain).alias("line"))


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through Spark's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(data)
    finally:
        out.close()


def write_files(files: DataFrame, path: str) -> None:
    """Write a file for each row of files(name, value), names being single and without slashes, by the executors: Spark has
    no sink for bytes, but its text sink writes strings as they are, and a line break behind, which the format must bear.
    The driver moves them to their names; no content comes to it."""
    spark, parts = files.sparkSession, f"{path}-parts"
    files.select("name", F.col("value").cast("string").alias("value")).write.mode("overwrite").option("compression", "none").partitionBy("name").text(parts)
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(new(path))
    for folder in fs.listStatus(new(parts)):
        if folder.isDirectory():
            for f in fs.listStatus(folder.getPath()):
                if f.getPath().getName().startswith("part-") and not fs.rename(f.getPath(), new(path, folder.getPath().getName().split("=", 1)[1])):
                    raise OSError(f"could not write {folder.getPath().getName()} under {path}")
    fs.delete(new(parts), True)


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made, z, first = io.BytesIO(), None, None
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if z is None:
                z, first = zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED), batch.column(2)[0].as_py()
                z.comment = b"\n"  # what the sink writes behind
            z.writestr(name, text)
    if z is not None:
        z.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{first:06}.zip"]), pa.array([made.getvalue()[:-1]], pa.binary())], ["name", "value"])


def write_zips(members: DataFrame, path: str, files: int) -> None:
    """Write members(name, text) to zip files under path, so many at most, each by one task."""
    dealt = members.select("name", "text").repartition(files, "name").withColumn("at", F.spark_partition_id())
    write_files(dealt.mapInArrow(_zipped, "name string, value binary"), path)


def _files(lines: DataFrame, most: int) -> Iterator[tuple[str, bytes]]:
    """The name and content of a file for each query, one at a time: at most `most` rows each."""
    name, rows = None, []
    for r in lines.where(F.col("rank") <= most).orderBy("query_id", "rank").toLocalIterator():
        if r["query_id"] != name:
            if rows:
                yield f"{name}.csv", ("\n".join(rows) + "\n").encode()
            name, rows = r["query_id"], []
        rows.append(r["line"])
    if rows:
        yield f"{name}.csv", ("\n".join(rows) + "\n").encode()


def write_submissions(lines: DataFrame, path: str, most: int = 100) -> int:
    """Write <query_id>.csv under path for each query; the number of files."""
    n = 0
    for name, data in _files(lines, most):
        put(lines.sparkSession, f"{path}/{name}", data)
        n += 1
    return n


def package_submissions(spark: SparkSession, folder: str, path: str, most: int = 100) -> int:
    """Write a zip with submission/<file> for each CSV file of a folder, if all of them are valid, else an error; the number
    of files. A file's task is in its name. They hold at most `most` rows, so what comes to the driver is bounded by the
    queries asked."""
    from keymoment.operators.quality import validate, validate_folders

    low = F.lower("file")
    task = F.when(low.contains("trake"), "trake").when(low.contains("qa"), "qa").otherwise("kis")
    lines = read_submissions(spark, folder).withColumn("task", task)
    checked = validate(lines, most)
    whole = validate_folders(checked, []).first()
    if not whole["files"] or not whole["all_valid"]:
        bad = [f"{r['file']}: {r['error']}" for r in checked.where("NOT valid").orderBy("file").limit(5).collect()]
        raise ValueError(f"not all files of {folder} are valid: {'; '.join(bad) or 'there are none'}")
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in _files(lines.select(F.col("file").alias("query_id"), F.col("row_no").alias("rank"), "line"), 1 << 30):
            z.writestr(f"submission/{name}", data)
    put(spark, path, made.getvalue())
    return whole["files"]


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
