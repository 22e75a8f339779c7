"""What the operators of this subpackage share: tables, shared scratch folders and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A local session without spark.checkpoint.dir gets a temporary folder; a cluster without it is refused, as its
    executors could not read what others wrote.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keymoment-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Intermediate tables of one operator call, written under the shared folder.

    A written table cuts the lineage and survives lost executors. Read back, it has no known partitioning, so a join
    puts an exchange of its own on it, which adaptive execution can split where a key is hot.
    """

    #: Where new folders go: that of a caller who deletes them once it has written what it wants of them.
    _within: list[str] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        above = self._within[-1] if self._within else f"{shared_dir(spark).rstrip('/')}/keymoment/{spark.sparkContext.applicationId}"
        self.path = f"{above}/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")

    def drop_but(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*(x for x in folders(self.spark, self.path) if x not in names))

    @contextmanager
    def lent(self, name: str):
        """Operators called inside put their tables in a folder of this one, deleted at the end."""
        self._within.append(f"{self.path}/{name}")
        try:
            yield
        finally:
            delete(self.spark, self._within.pop())


def folders(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Delete the scratch tables of this application, once no result that reads them is needed any more."""
    delete(spark, f"{shared_dir(spark).rstrip('/')}/keymoment/{spark.sparkContext.applicationId}")


#: Bits of a sieve for each of its keys, and at most: what is broadcast has at most 128 MB, however many the keys.
SIEVE_BITS, SIEVE_MOST = 16, 1 << 30
_SLOT = 1 << 15


class Sieve:
    """A bitmap of the hashes of keys, by which rows are thinned before they are shuffled: it lets all rows of its keys
    pass, and a share of others that is small as long as the bound on its size allows SIEVE_BITS bits a key."""

    def __init__(self, keys: DataFrame, *names: str):
        n = keys.count()
        self.size = min(SIEVE_MOST, max(_SLOT, 1 << (SIEVE_BITS * n).bit_length()))
        at = self._place(*names)
        self.slots = keys.select(F.floor(at / _SLOT).cast("int").alias("slot"), (at % _SLOT).alias("bit")).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))

    def _place(self, *names) -> Column:
        return F.pmod(F.xxhash64(*names), F.lit(self.size))

    def split(self, rows: DataFrame, *names: str, passing: bool) -> DataFrame:
        """The rows that pass, or the others."""
        at = self._place(*names)
        slots = F.broadcast(self.slots.select(F.col("slot").alias("__sieve_slot"), F.col("bits").alias("__sieve_bits")))  # size / 8 bytes at most
        byte = F.conv(F.hex(F.substring("__sieve_bits", F.floor((at % _SLOT) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.getbit(F.coalesce(byte, F.lit(0)), (at % 8).cast("int")) == 1
        joined = rows.join(slots, F.floor(at / _SLOT).cast("int") == F.col("__sieve_slot"), "inner" if passing else "left")
        return joined.where(hit if passing else ~hit).drop("__sieve_slot", "__sieve_bits")


def located(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(whole, file, row): each row of docs as a struct, and where its content lies. A plain reading of files has that by
    itself; anything else is written to the shared folder first, so that a row's place is its own and stays."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    plan, names = docs._jdf.queryExecution().analyzed(), []
    while True:
        names.append(plan.nodeName())
        if plan.children().size() != 1:
            break
        plan = plan.children().apply(0)
    plain = names[-1] == "LogicalRelation" and set(names[:-1]) <= {"Project", "Filter", "SubqueryAlias"} and "_metadata" not in {c.lower() for c in docs.columns}
    if plain and "HadoopFsRelation" in plan.relation().getClass().getName():
        return docs.select(whole, *place)
    return scratch.keep(docs.select(whole), "located").select("whole", *place)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a located() table, unpacked, but those at the places gone(file, row). Only rows that pass a sieve of
    the places are shuffled; all others go straight through."""
    columns = [F.col(f"whole.`{c}`").alias(c) for c in rows.schema["whole"].dataType.names]
    sieve = Sieve(gone, "file", "row")
    stay = sieve.split(rows, "file", "row", passing=False).select(*columns)
    rest = sieve.split(rows, "file", "row", passing=True).join(gone.select("file", "row"), ["file", "row"], "left_anti")
    return stay.unionAll(rest.select(*columns))


def bounded_sample(df: DataFrame, rows: int, keys: list[str], seed: int = 0, pick: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """At most `rows` rows, those of least hash of keys. Rows are counted first and thinned by the hash to about one and a
    half times as many, so that what tasks hand on to be ordered doesn't grow with their number. pick: what is wanted of
    the rows, made before they are moved."""
    n = df.count()
    mixed = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30))
    share = min(1.0, (1.5 * rows + 64) / max(1, n))
    thin = df.where(mixed < int(share * (1 << 30)))
    if pick is None:
        return thin.orderBy(mixed, *keys).limit(rows)
    return pick(thin.withColumn("__order", mixed)).orderBy("__order").limit(rows).drop("__order")


def map_text(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[bytes]], list[list]]], fields: list[tuple[str, str]], keep: list[str] | None = None) -> DataFrame:
    """Append columns that a Python function computes from whole texts (UTF-8 bytes, null as empty).

    make() runs once a task and returns the function, which gets a list of texts and returns a list for each field.
    keep: the columns that stay, all by default. A field replaces a kept column of the same name (without case), as
    withColumn does. Memory is bounded by an Arrow batch (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    new = {n.lower() for n, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    added = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = [f.name for f in schema.fields]
    at = -1 if text_col not in kept else kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                cells = part.column(at if at >= 0 else part.num_columns - 1)
                texts = [x or b"" for x in cells.cast(pa.binary() if not pa.types.is_large_string(cells.type) else pa.large_binary()).to_pylist()]
                out = [pa.array(x, k) for x, k in zip(f(texts), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + out, names)

    source = df.select(*[F.col(f"`{c}`") for c in kept], *([] if at >= 0 else [F.col(f"`{text_col}`")]))
    if source.schema[-1 if at < 0 else at].dataType != T.StringType():
        raise TypeError(f"{text_col} must be a string column")
    return source.mapInArrow(run, schema)
