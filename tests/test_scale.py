"""What keeps large tables from costing more than their share: windows, the text index, files written by executors."""

from __future__ import annotations

import random
import time
import zipfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from keymoment import catalog
from keymoment.functions import text as X
from keymoment.operators import bm25_index, temporal
from keymoment.operators.bm25 import bm25
from keymoment.plans import api_queries, search_api
from keymoment.sources import readers
from keymoment.sources.standard import Tables


def plan(df) -> str:
    return df._jdf.queryExecution().toString().lower()


def tables(spark, folder, **of):
    """Small tables in a folder; of: rows and schema by name."""
    for name, (rows, schema) in of.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def moments(seed: int):
    """Frames and segment starts of five videos over many buckets, with ties, a video without the others and one unnamed."""
    rng = random.Random(seed)
    frames = [(f"V{i % 5}", rng.randrange(0, 3_000_000, 500), i) for i in range(400)] + [("W", 5, 900), (None, 1000, 901), ("V1", None, 902)]
    starts = [(f"V{i % 4}", rng.randrange(0, 3_000_000, 500)) for i in range(60)] + [("X", 3), (None, 1000), ("V1", None), ("V0", 700_000), ("V0", 700_000)]
    return frames, starts


def test_blind_spots_of_long_conversations(spark, tmp_path):
    """turns of 100 and more keep their conversation, and no window ends unbounded."""
    folder = tables(spark, tmp_path, embeddings=([(i, i % 10, [1.0, 0.0]) for i in range(400)], "vec_id bigint, label bigint, embedding array<float>"),
                    conversations=([(c, n, "x") for c in (1, 2, 150) for n in (0, 99, 100, 250)], "conv_id bigint, turn bigint, text string"))
    out = catalog.queries()["asr_blind_spot_check"](spark, folder)
    want = {(c, n): min(abs(i * 2000 - (c * 4000 + n * 1000)) for i in range(400) if i % 10 == c % 10) > 800 for c in (1, 2, 150) for n in (0, 99, 100, 250)}
    assert {(r["conv_id"], r["turn"]): r["blind"] for r in out.collect()} == want
    assert "unboundedfollowing" not in plan(out)


def test_nearest_segments_over_buckets(spark):
    """as all pairs tell, without a window that ends unbounded."""
    frames, starts = moments(6)
    f, s = spark.createDataFrame(frames, "video_id string, pts_ms bigint, global_id bigint"), spark.createDataFrame(starts, "video_id string, start_ms bigint")
    out = temporal.nearest_segment(f, s)
    want = {i: min((x for v, x in starts if v == video and v is not None and x is not None and t is not None), key=lambda x, t=t: (abs(x - t), x), default=None) for video, t, i in frames}
    assert {r["global_id"]: r["start_ms"] for r in out.collect()} == want and out.count() == len(frames)
    assert "unboundedfollowing" not in plan(out)


def test_gaps_over_buckets(spark):
    """as the sorted lists tell, keyframes of one number included, without a window that ends unbounded."""
    keys, targets = moments(10)
    keys = [(v, t // 40) for v, t, _ in keys if v and t is not None] + [("V2", 2000), ("V2", 2000), ("V3", 75_000), ("V3", 75_000)]
    targets = {(v, x // 40 + d) for v, x in targets if v and x is not None for d in (0, 7)} | {("V2", 2000), ("V3", 75_000), ("V0", 10**7), ("V9", 1), ("W", 4)}
    out = temporal.gap_around(spark.createDataFrame(keys, "video_id string, frame_idx bigint"), spark.createDataFrame(sorted(targets), "video_id string, target bigint"))
    want = {}
    for v, x in targets:
        k = sorted(n for u, n in keys if u == v)
        i = min(sum(n < x for n in k), len(k) - 1)
        want[v, x] = max(x - k[max(i - 1, 0)], k[min(i + 1, len(k) - 1)] - x) if len(k) > 1 else 100
    assert {(r["video_id"], r["target"]): r["gap"] for r in out.collect()} == want and out.count() == len(targets)
    assert all(r["large"] for r in out.where("video_id IN ('V9', 'W')").collect())
    assert "unboundedfollowing" not in plan(out)


def test_tokens_of_long_runs(spark):
    """a run of letters without a hyphen is gone through once, not once for each of its letters."""
    run = "a1" * 200_000
    began = time.time()
    got = spark.createDataFrame([(f"{run} x-ray é1 aa-bb-cc {run}",)], "text string").select(X.tokens_dual(F.col("text")).alias("t")).first()["t"]
    assert set(got) == {run, "x-ray", "xray", "ray", "é1", "e1", "aa-bb", "aabb", "aa", "bb", "cc"} and len(got) == len(set(got))
    assert time.time() - began < 20


def test_index_of_own_ids_is_sorted_by_key_in_each_file(spark, tmp_path):
    """F2, F3, F7, F8: each file's postings are in the order of their key, and ids that several rows have are counted together."""
    said = [(i % 40, " ".join(random.Random(i).sample("alpha beta gamma delta epsilon zeta the of".split(), 4))) for i in range(60)] + [(None, "alpha the"), (None, "the beta"), (70, None), (71, "alpha")]
    docs = spark.createDataFrame(said, "id bigint, text string").repartition(3)
    tokens = X.tokens_dual(F.col("text"))
    rows = lambda path, name: sorted(repr(r) for r in spark.read.parquet(f"{path}/{name}").select(*[F.round(c, 9).alias(c) if c in ("raw", "avgdl", "mean") else c for c in sorted(spark.read.parquet(f"{path}/{name}").columns)]).collect())
    for name, d in (("all", docs), ("own", docs.where("id > 19"))):
        for sets in (True, False):
            bm25_index.write_index(d, "id", tokens, f"file://{tmp_path}/{name}-{sets}", sets=sets)
        for part in ("postings", "vocabulary", "corpus"):
            assert rows(f"file://{tmp_path}/{name}-True", part) == rows(f"file://{tmp_path}/{name}-False", part)
    assert spark.read.parquet(f"file://{tmp_path}/all-True/postings").agg(F.max("tf")).first()[0] == 2
    files = list(tmp_path.glob("own-True/postings/*/*.parquet"))
    assert files and all(k == sorted(k) for k in (pq.read_table(f, columns=["key"], partitioning=None)["key"].to_pylist() for f in files))
    many = {"q": [*"alpha the zeta".split(), *map(str, range(30))]}
    found = bm25_index.score(spark, f"file://{tmp_path}/own-True", bm25_index.asked(spark, many))
    assert {r["doc"]: r["score"] for r in found.collect()} == {r["id"]: r["score"] for r in bm25(docs.where("id > 19"), "id", tokens, many["q"]).collect()}


def test_sequences_need_no_text_index(spark):
    """a batch of sequences alone builds no index."""
    def never():
        raise AssertionError("an index was asked for")

    t = Tables(spark, "/root/testdata/sf0.001")
    batch = api_queries._batch(t, [("s1", "trake", "E1 E2 E3", 7, None, [], [], None, [3, 42, 99])])
    out = search_api.run(search_api.Corpus(t.features, never, never, work=t.work()), batch, "a7")
    assert out.count() == 100 and {r["task_type"] for r in out.collect()} == {"trake"}


def test_raw_formats_are_written_by_executors(spark, monkeypatch):
    """no rows come to the driver to be written."""
    def never(*_, **__):
        raise AssertionError("rows were asked for by the driver")

    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", never)
    for name, table in (("scan_objects", "events"), ("scan_keyframe_maps", "embeddings"), ("scan_vectors", "embeddings")):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()


def test_zips_of_executors_are_zips(spark, tmp_path):
    said = {f"a/{i}.json": f"tiếng {i}" for i in range(50)}
    readers.write_zips(spark.createDataFrame(list(said.items()), "name string, text string"), f"file://{tmp_path}/z", 3)
    got = {}
    for f in tmp_path.glob("z/*.zip"):
        with zipfile.ZipFile(f) as z:
            assert z.testzip() is None
            got |= {n: z.read(n).decode() for n in z.namelist()}
    assert got == said and not list(tmp_path.glob("z-parts"))
    readers.write_zips(spark.createDataFrame([], "name string, text string"), f"file://{tmp_path}/none", 3)
    assert readers.read_members(spark, f"file://{tmp_path}/z", ".json").count() == 50
