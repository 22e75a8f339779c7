"""Vector search: exact top-k by inner product, batches, pooling per video, gating.

Inner products are matrix products over Arrow batches, in double. Query vectors go to the tasks as one matrix, in blocks
of at most QUERY_BYTES, each block being one pass over the frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BYTES = 64 << 20
_ROWS = 1024
# The encoders that frames may be of, and the lengths of their vectors.
ENGINES = {"clip": 512, "siglip2": 1152}


def dimension(engine: str) -> int:
    """The length of an encoder's vectors; an unknown one is an error."""
    if engine not in ENGINES:
        raise ValueError(f"unknown engine {engine!r}: one of {', '.join(ENGINES)}")
    return ENGINES[engine]


def encode(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], engine: str, text: str = "text", name: str = "vector") -> DataFrame:
    """Appends a vector to each row, by an encoder that takes a list of texts, as a stage over Arrow batches; vectors that
    aren't of the engine's length are an error."""
    width, kept = dimension(engine), texts.columns
    schema = T.StructType([*texts.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [x or "" for x in batch.column(kept.index(text)).to_pylist()]
            made = np.asarray(encoder(said), np.float32).reshape(len(said), -1) if said else np.zeros((0, width), np.float32)
            if made.shape[1] != width:
                raise ValueError(f"vectors of {engine} have {width} values, not {made.shape[1]}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(made), pa.list_(pa.float32()))], schema.names)

    return texts.mapInArrow(run, schema)


def _products(cells: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Inner products of a column of vectors with the rows of a matrix; null vectors have none (nan)."""
    out = np.full((len(cells), len(vectors)), np.nan)
    there = np.flatnonzero(~np.asarray(cells.is_null()))
    for start in range(0, len(there), _ROWS):
        at = there[start : start + _ROWS]
        part = cells.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
        if part.shape[1] != vectors.shape[1]:
            raise ValueError(f"frames' vectors have {part.shape[1]} values, the query's {vectors.shape[1]}")
        out[at] = part @ vectors.T
    return out


def with_similarities(frames: DataFrame, vectors: dict[str, list[float]]) -> DataFrame:
    """Frames without their vectors, with a column of inner products for each of a few vectors; frames without one have null."""
    kept = [c for c in frames.columns if c != "embedding"]
    names, matrix = list(vectors), np.array(list(vectors.values()), np.float64)
    schema = T.StructType([*(frames.schema[c] for c in kept), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _products(batch.column(len(kept)), matrix)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *(pa.array(s[:, j], from_pandas=True) for j in range(len(names)))], schema.names)

    return frames.select(*kept, "embedding").mapInArrow(run, schema)


def with_similarity(frames: DataFrame, query: list[float], name: str = "s") -> DataFrame:
    return with_similarities(frames, {name: query})


def _blocks(queries: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """The ids and vectors of queries(query_id, vector), a query set, in blocks of bounded size."""
    rows = queries.select("query_id", "vector").toLocalIterator()
    first = next(rows, None)
    if first is None:
        return
    many = max(1, QUERY_BYTES // (8 * len(first["vector"])))
    block = [first, *islice(rows, many - 1)]
    while block:
        yield [r["query_id"] for r in block], np.array([r["vector"] for r in block], np.float64)
        block = list(islice(rows, many))


def all_similarities(frames: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ..., s) of all frames with all queries(query_id, vector): for a few queries, whose callers thin the frames."""
    found = None
    for ids, vectors in _blocks(queries):
        part = _nearest(frames, ids, vectors, None)
        found = part if found is None else found.unionAll(part)
    return _nearest(frames.where("false"), [], np.zeros((0, 1)), None) if found is None else found


def _nearest(frames: DataFrame, ids: list[str], vectors: np.ndarray, k: int | None) -> DataFrame:
    """(query_id, ..., s): of each batch of frames the k best of each query, so that little is left to be ranked."""
    kept = [c for c in frames.columns if c != "embedding"]
    at_id = kept.index("global_id")
    schema = T.StructType([T.StructField("query_id", T.StringType()), *(frames.schema[c] for c in kept), T.StructField("s", T.DoubleType())])
    shared = frames.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            s = _products(batch.column(len(kept)), matrix)
            own = batch.column(at_id).to_numpy(zero_copy_only=False)
            for j, name in enumerate(names):
                best = np.flatnonzero(~np.isnan(s[:, j]))
                if k is not None and len(best) > k:
                    edge = np.partition(s[best, j], len(best) - k)[len(best) - k]
                    best = best[s[best, j] >= edge]
                best = best[np.lexsort((own[best], -s[best, j]))[:k]]
                rows = pa.array(best)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(best), pa.string()), *(batch.column(i).take(rows) for i in range(len(kept))), pa.array(s[best, j])], schema.names)

    return frames.select(*kept, "embedding").mapInArrow(run, schema)


def knn_exact(frames: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k frames of greatest inner product, ranked; ties by global_id. Each batch hands on k rows at most."""
    best = _nearest(frames, ["q"], np.array([query], np.float64), k).drop("query_id").orderBy(F.desc("s"), "global_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "global_id")))


def knn_batch(frames: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """knn_exact for all queries(query_id, vector) at once: (query_id, rank, ...). Under the optimizer's window group limit (k
    up to 1000 by default) each task drops all but a query's k best before the shuffle."""
    found = None
    for ids, vectors in _blocks(queries):
        part = _nearest(frames, ids, vectors, k)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = _nearest(frames.where("false"), [], np.zeros((0, 1)), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "global_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pool_size(k: int) -> int:
    """Frames that each event's vector, and the whole query's, bring in for sequence search."""
    return max(500, 5 * k)


def softmax_pool(similar: DataFrame, tau: float = 0.05, by: str = "video_id") -> DataFrame:
    """Per video: pooled (softmax-weighted mean of similarities), best (largest) and mixed (0.7 and 0.3 of them)."""
    top = similar.groupBy(by).agg(F.max("s").alias("best"))
    w = F.exp((F.col("s") - F.col("best")) / tau)
    out = similar.join(top, by).groupBy(by, "best").agg((F.sum(w * F.col("s")) / F.sum(w)).alias("pooled"))
    return out.withColumn("mixed", 0.7 * F.col("pooled") + 0.3 * F.col("best"))


def top_mean(similar: DataFrame, k: int = 3, by: str = "video_id") -> DataFrame:
    """Per video the mean of the k best similarities, or of those that it has."""
    order = Window.partitionBy(by).orderBy(F.desc("s"), "global_id")
    return similar.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy(by).agg(F.avg("s").alias("top_mean"))


def softmax(values: list[Column], tau: float) -> list[Column]:
    e = [F.exp(v / tau) for v in values]
    total = e[0]
    for x in e[1:]:
        total = total + x
    return [x / total for x in e]


def refine_argmax(similar: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """Of frames of [start, end] every step frames: the best, and least, greatest and mean similarity, per video."""
    inside = similar.where(F.col("frame_idx").between(start, end) & ((F.col("frame_idx") - start) % step == 0))
    return inside.groupBy("video_id").agg(F.max_by("frame_idx", F.struct("s", (-F.col("frame_idx")).alias("f"))).alias("frame_idx"), F.min("s").alias("least"), F.max("s").alias("most"), F.avg("s").alias("mean"))
