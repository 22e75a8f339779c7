"""Queries of the plain operators: text scans, filters of hits and scores, key joins, sorting, vocabulary, run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from keymoment.functions import text as X
from keymoment.operators import evaluate as E
from keymoment.operators import search
from keymoment.plans.lexical_queries import CONV, spoken
from keymoment.plans.rank_queries import _D, _TASK, _details, _truth
from keymoment.plans.registry import FRAMES, OCR, TRANSCRIPTS, TRUTH, query, sim, toks
from keymoment.plans.vector_queries import similar

r6 = lambda c: F.round(c, 6).alias(c)
WITH = f"WITH {FRAMES}, {sim()}"
NO_ROW = (-1, 0, 7, 11, 1_000_000_000)
LOOKED_UP = (0, 350, 12_345)


@query(f"WITH {OCR} SELECT doc_id, global_id, coalesce(ocr_text, '') AS ocr_text, 0.0::DOUBLE AS confidence FROM ocr")
def scan_ocr(t):
    return t.ocr.select("doc_id", "global_id", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"), F.lit(0.0).alias("confidence"))


@query(f"WITH {TRANSCRIPTS} SELECT video_id, start_ms, end_ms, start_frame, end_frame, coalesce(transcript, '') AS transcript FROM transcripts")
def scan_asr(t):
    return t.transcripts.select("video_id", "start_ms", "end_ms", "start_frame", "end_frame", F.coalesce("transcript", F.lit("")).alias("transcript"))


@query(f"WITH {FRAMES} SELECT h.id AS global_id, video_id FROM (VALUES {', '.join(f'({i})' for i in NO_ROW)}) h(id) JOIN frames f ON f.global_id = h.id")
def valid_hit_filter(t):
    hits = t.spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in NO_ROW])).alias("global_id"))
    return t.features.join(F.broadcast(hits), "global_id").select("global_id", "video_id")  # as many rows as ids are asked for


@query("SELECT event_id, round(CASE WHEN n > 0.1 THEN 0.15::DOUBLE * n ELSE 0.0::DOUBLE END, 6) AS bonus FROM (SELECT event_id, CAST(value AS DOUBLE) / (SELECT max(CAST(value AS DOUBLE)) FROM events) AS n FROM events)")
def norm_signal_filter(t):
    from keymoment.operators.fusion import max_normalised

    n = max_normalised(t.read("events").select("event_id", F.col("value").cast("double").alias("score")))
    return n.select("event_id", F.round(F.when(F.col("norm") > 0.1, 0.15 * F.col("norm")).otherwise(0.0), 6).alias("bonus"))


@query(f"{WITH} SELECT global_id, round(s, 6) AS s FROM sim WHERE s > 0")
def positive_score_filter(t):
    return similar(t).where("s > 0").select("global_id", r6("s"))


@query(f"{WITH}, b AS (SELECT video_id, max(s) AS best FROM sim GROUP BY 1) SELECT video_id, round(0.7::DOUBLE * sum(exp((s - best) / 0.05::DOUBLE) * s) / sum(exp((s - best) / 0.05::DOUBLE)) + 0.3::DOUBLE * max(best), 6) AS video_score FROM sim JOIN b USING (video_id) GROUP BY 1")
def video_score_mix(t):
    return search.softmax_pool(similar(t)).select("video_id", F.round("mixed", 6).alias("video_score"))


@query(f"{WITH} SELECT global_id, round(s, 6) AS s FROM sim ORDER BY sim.s DESC, global_id LIMIT 25")
def topk_sort(t):
    return similar(t).orderBy(F.desc("s"), "global_id").limit(25).select("global_id", r6("s"))


@query(f"WITH {FRAMES}, {OCR}, o AS (SELECT doc_id, global_id, global_id * 50 + doc_id % 2 AS frame_idx FROM ocr) SELECT doc_id, video_id, o.frame_idx AS frame_idx_ocr, f.frame_idx AS frame_idx_frame FROM o JOIN frames f USING (global_id)")
def join_equi_suffixes(t):
    o = t.ocr.select("doc_id", "global_id", (F.col("global_id") * 50 + F.col("doc_id") % 2).alias("frame_idx_ocr"))
    return o.join(t.features.select("global_id", "video_id", F.col("frame_idx").alias("frame_idx_frame")), "global_id").select("doc_id", "video_id", "frame_idx_ocr", "frame_idx_frame")


@query(f"WITH {FRAMES}, k AS (SELECT video_id, x AS frame_idx FROM (SELECT DISTINCT video_id FROM frames), (VALUES {', '.join(f'({x})' for x in LOOKED_UP)}) v(x)) SELECT k.video_id, k.frame_idx, coalesce(f.pts_time, k.frame_idx / 25.0::DOUBLE) AS pts_time, f.frame_idx IS NOT NULL AS exact FROM k LEFT JOIN frames f USING (video_id, frame_idx)")
def point_lookup(t):
    """The time of (video, frame): that of the frame's row, else by 25 frames a second."""
    keys = t.features.select("video_id").distinct().withColumn("frame_idx", F.explode(F.array(*[F.lit(x).cast("long") for x in LOOKED_UP])))
    rows = t.features.select("video_id", "frame_idx", (F.col("pts_ms") / 1000.0).alias("pts"))
    return keys.join(rows, ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", F.coalesce("pts", F.col("frame_idx") / 25.0).alias("pts_time"), F.col("pts").isNotNull().alias("exact"))


@query(f"WITH {CONV} SELECT token, count(*) AS df, min(seg_id) AS first_seg FROM (SELECT seg_id, unnest({toks('transcript')}) AS token FROM spoken) GROUP BY 1")
def bm25_vocabulary(t):
    """The index's vocabulary table: in how many segments a token stands, and the first of them."""
    p = spoken(t).select("seg_id", F.explode(X.tokens_dual(F.col("transcript"))).alias("token"))
    return p.groupBy("token").agg(F.count("*").alias("df"), F.min("seg_id").alias("first_seg"))


@query(f"WITH {TRUTH} SELECT query_id, true_video, start_frame + (end_frame - start_frame) // 2 AS mid_frame FROM truth")
def oracle_qa(t):
    return _truth(t).select("query_id", "true_video", F.expr("start_frame + (end_frame - start_frame) div 2").alias("mid_frame"))


@query(f"""WITH {_D}, k AS (SELECT *, {_TASK} AS task_type, 100.0::DOUBLE + CAST(right(query_id, 3) AS INTEGER) AS latency_ms FROM det) SELECT coalesce(task_type, 'all') AS task_type, round(avg(final), 6) AS score, {', '.join(f"round(avg(CASE WHEN coalesce(video_rank, 999999) <= {k} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS video_r_{k}" for k in (1, 5, 20, 100))}, round(avg(latency_ms), 6) AS latency_ms FROM k GROUP BY ROLLUP (task_type)""")
def run_summary(t):
    k = _details(t).withColumn("task_type", F.when(F.col("query_id") < "q-V005", "kis").otherwise("qa"))
    k = k.withColumn("latency_ms", 100.0 + F.substring("query_id", -3, 3).cast("int"))
    return E.run_report(k).select("task_type", r6("score"), *[r6(f"video_r_{d}") for d in (1, 5, 20, 100)], r6("latency_ms"))
