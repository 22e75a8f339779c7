"""Queries of joins by time, aggregates, diversification, metrics and quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keymoment.functions.text import STOP_WORDS, answers_match, normalize_answer
from keymoment.operators import evaluate as E
from keymoment.operators import quality, ranking, search, temporal
from keymoment.plans.registry import FRAMES, OBJECTS, OCR, PREDICTED, TRANSCRIPTS, TRUTH, pool, query, sim

r6 = lambda c: F.round(c, 6).alias(c)
FT = f"WITH {FRAMES}, {TRANSCRIPTS}"
PLACED = "'V' || lpad(CAST(conv_id % 10 AS VARCHAR), 3, '0')"


@query(f"WITH {FRAMES} SELECT video_id, min(global_id) AS first_global_id, max(global_id) AS last_global_id, count(*) AS num_keyframes FROM frames GROUP BY 1")
def video_ranges(t):
    return t.features.groupBy("video_id").agg(F.min("global_id").alias("first_global_id"), F.max("global_id").alias("last_global_id"), F.count("*").alias("num_keyframes"))


@query(f"WITH {FRAMES}, p AS (SELECT p_partkey, p_name, 'V' || lpad(CAST(p_partkey % 15 AS VARCHAR), 3, '0') AS video_id FROM part), r AS (SELECT video_id, count(*) AS num_keyframes FROM frames GROUP BY 1) SELECT p_partkey, video_id, num_keyframes FROM p LEFT JOIN r USING (video_id)")
def join_left_ranges(t):
    p = t.read("part").select("p_partkey", F.concat(F.lit("V"), F.lpad((F.col("p_partkey") % 15).cast("string"), 3, "0")).alias("video_id"))
    return p.join(video_ranges(t).select("video_id", "num_keyframes"), "video_id", "left").select("p_partkey", "video_id", "num_keyframes")


@query(f"""WITH {FRAMES}, {OCR}, {OBJECTS}, oc AS (SELECT global_id, count(*) AS n_ocr, min(doc_id) AS first_doc FROM ocr GROUP BY 1), ob AS (SELECT global_id, count(*) AS n_objects FROM objects GROUP BY 1), v AS (SELECT video_id, count(*) AS num_keyframes FROM frames GROUP BY 1)
SELECT global_id, video_id, n_ocr, first_doc, n_objects, num_keyframes FROM frames LEFT JOIN oc USING (global_id) LEFT JOIN ob USING (global_id) LEFT JOIN v USING (video_id)""")
def join_360_view(t):
    oc = t.ocr.groupBy("global_id").agg(F.count("*").alias("n_ocr"), F.min("doc_id").alias("first_doc"))
    ob = t.objects.groupBy("global_id").agg(F.count("*").alias("n_objects"))
    f = t.features.select("global_id", "video_id").join(oc, "global_id", "left").join(ob, "global_id", "left").join(video_ranges(t).select("video_id", "num_keyframes"), "video_id", "left")
    return f.select("global_id", "video_id", "n_ocr", "first_doc", "n_objects", "num_keyframes")


@query(f"{FT} SELECT f.global_id, s.conv_id, s.turn FROM frames f JOIN transcripts s ON f.video_id = s.video_id AND f.pts_ms BETWEEN s.start_ms - 1000 AND s.end_ms + 1000")
def join_point_in_interval(t):
    return temporal.points_in_intervals(t.features.select("global_id", "video_id", "pts_ms"), t.transcripts, 1000).select("global_id", "conv_id", "turn")


@query(f"WITH {TRANSCRIPTS} SELECT conv_id, turn FROM transcripts WHERE start_ms <= 200000 AND end_ms >= 100000")
def join_interval_overlap(t):
    return temporal.overlapping(t.transcripts, 100_000, 200_000).select("conv_id", "turn")


@query(f"{FT} SELECT f.global_id, (SELECT arg_min(s.start_ms, abs(s.start_ms - f.pts_ms) * 2 + CASE WHEN s.start_ms > f.pts_ms THEN 1 ELSE 0 END) FROM transcripts s WHERE s.video_id = f.video_id) AS start_ms FROM frames f")
def asof_nearest_segment(t):
    return temporal.nearest_segment(t.features.select("global_id", "video_id", "pts_ms"), t.transcripts).select("global_id", "start_ms")


@query(f"WITH {FRAMES}, a AS (SELECT video_id, x FROM (SELECT DISTINCT video_id FROM frames), (VALUES (0), (777), (12345)) v(x)) SELECT a.video_id, x AS target, arg_min(frame_idx, abs(frame_idx - x) * 100000 + frame_idx) AS nearest FROM a JOIN frames USING (video_id) GROUP BY ALL")
def nearest_frame(t):
    at = t.features.select("video_id").distinct().withColumn("target", F.explode(F.array(F.lit(0), F.lit(777), F.lit(12345))))
    return temporal.nearest_frame(t.features.select("video_id", "frame_idx"), at).select("video_id", "target", "nearest")


@query("SELECT DISTINCT c.conv_id FROM conversations c WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id)")
def semi_candidates(t):
    return t.read("conversations").select("conv_id").distinct().join(t.read("labels").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_semi")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_resume(t):
    return t.read("documents").select("doc_id").join(t.read("labels").select("doc_id"), "doc_id", "left_anti")


@query(f"""WITH {OBJECTS}, e AS (SELECT global_id, entity, count(*) AS c, count(*) FILTER (WHERE score > 0.3) AS sure, max(score) AS best FROM objects GROUP BY ALL)
SELECT global_id, CAST(coalesce(sum(sure) FILTER (WHERE entity IN ('view', 'click')), 0) AS BIGINT) AS person_count, array_to_string(list_slice(list(entity ORDER BY c DESC, entity), 1, 5), ',') AS top_entities, coalesce(array_to_string(list(entity ORDER BY entity) FILTER (WHERE best > 0.7), ','), '') AS high_conf_entities FROM e GROUP BY 1""")
def object_summary(t):
    return quality.object_summary(t.objects, ["view", "click"])


@query(f"WITH {FRAMES}, {OCR} SELECT global_id, max(length(ocr_text)) AS best FROM ocr GROUP BY 1")
def max_per_key(t):
    return t.ocr.groupBy("global_id").agg(F.max(F.char_length("ocr_text")).cast("long").alias("best"))


@query("SELECT event_id, round(CAST(value AS DOUBLE) / (SELECT max(CAST(value AS DOUBLE)) FROM events), 6) AS norm FROM events")
def global_max_norm(t):
    from keymoment.operators.fusion import max_normalised

    return max_normalised(t.read("events").select("event_id", F.col("value").cast("double").alias("score"))).select("event_id", r6("norm"))


@query("SELECT count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (WHERE text IS NULL) AS null_texts, round(100.0::DOUBLE * count(text) / count(*), 4) AS coverage, round(avg(n_chars), 4) AS mean_chars FROM documents")
def profile_table(t):
    return t.read("documents").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_if(F.col("text").isNull()).alias("null_texts"), F.round(100.0 * F.count("text") / F.count("*"), 4).alias("coverage"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE CAST(value AS DOUBLE) / 50 > 0.3) AS sure, count(*) FILTER (WHERE CAST(value AS DOUBLE) / 50 > 0.7) AS high FROM events GROUP BY 1")
def conf_threshold(t):
    v = F.col("value").cast("double") / 50
    return t.read("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(v > 0.3).alias("sure"), F.count_if(v > 0.7).alias("high"))


@query(f"WITH {FRAMES}, l AS (SELECT video_id, max(pts_time) + 2 AS length FROM frames GROUP BY 1) SELECT global_id, round(least(1.0::DOUBLE, pts_time / length), 6) AS position_ratio FROM frames JOIN l USING (video_id)")
def position_ratio(t):
    f = t.features.select("global_id", "video_id", (F.col("pts_ms") / 1000.0).alias("pts_time"))
    length = f.groupBy("video_id").agg((F.max("pts_time") + 2).alias("length"))
    return f.join(length, "video_id").select("global_id", F.round(F.least(F.lit(1.0), F.col("pts_time") / F.when(F.col("length") == 0, 1.0).otherwise(F.col("length"))), 6).alias("position_ratio"))


@query(f"WITH {FRAMES}, m AS (SELECT video_id, min(frame_idx) AS first FROM frames GROUP BY 1), h AS (SELECT event_id, 'V' || lpad(CAST(user_id % 12 AS VARCHAR), 3, '0') AS video_id, event_id % 50 - 10 AS f FROM events) SELECT event_id, CASE WHEN f < 0 THEN coalesce(first, 0) ELSE f END AS frame_idx FROM h LEFT JOIN m USING (video_id)")
def negative_frame_fallback(t):
    m = t.features.groupBy("video_id").agg(F.min("frame_idx").alias("first"))
    h = t.read("events").select("event_id", F.concat(F.lit("V"), F.lpad((F.col("user_id") % 12).cast("string"), 3, "0")).alias("video_id"), (F.col("event_id") % 50 - 10).alias("f"))
    return h.join(m, "video_id", "left").select("event_id", F.when(F.col("f") < 0, F.coalesce("first", F.lit(0))).otherwise(F.col("f")).alias("frame_idx"))


@query("SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: z[2] = 1 OR lower(z[1]) <> lower(l[z[2] - 1])), lambda z: z[1]), ' ') AS text FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\s+') AS l FROM documents)")
def adjacent_dedup_concat(t):
    d = t.read("documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("l"))
    return d.select("doc_id", F.array_join(temporal.dedup_adjacent(F.col("l")), " ").alias("text"))


_POOL = f"WITH {FRAMES}, {sim()}, {pool()}"


def ranked(t, k: int = 200):
    return search.knn_exact(t.features, t.vector(7), k).withColumn("query_id", F.lit("q"))


@query(f"{_POOL}, x AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx // 5000 ORDER BY rank) > 1 AS late FROM pool) SELECT global_id, row_number() OVER (ORDER BY late, rank) AS place FROM x QUALIFY place <= 100")
def dedup_window(t):
    return ranking.dedup_window(ranked(t), 100, 5000).select("global_id", F.col("place").cast("long").alias("place"))


@query(f"{_POOL} SELECT video_id, min(rank) AS best_rank, row_number() OVER (ORDER BY min(rank)) AS video_rank FROM pool GROUP BY 1")
def unique_video_order(t):
    return ranking.video_order(ranked(t)).select("video_id", F.col("best_rank").cast("long").alias("best_rank"), F.col("video_rank").cast("long").alias("video_rank"))


@query(f"""{_POOL}, o AS (SELECT video_id, min(rank) AS br, row_number() OVER (ORDER BY min(rank)) AS vr FROM pool GROUP BY 1 QUALIFY vr <= 3), b AS (SELECT o.*, p.frame_idx AS best, greatest(4, 20 // (SELECT count(*) FROM o)) AS each FROM o JOIN pool p ON p.rank = o.br),
n AS (SELECT b.*, f.frame_idx, row_number() OVER (PARTITION BY b.video_id ORDER BY abs(f.frame_idx - best), f.frame_idx) AS r FROM b JOIN frames f USING (video_id) QUALIFY r <= each) SELECT row_number() OVER (ORDER BY a, b) AS place, video_id, frame_idx FROM (SELECT video_id, frame_idx, min(o).a AS a, min(o).b AS b FROM (SELECT video_id, frame_idx, {{'a': vr, 'b': r}} AS o FROM n UNION ALL SELECT video_id, frame_idx, {{'a': 1000, 'b': rank}} FROM pool) GROUP BY ALL) QUALIFY place <= 20""")
def spread_per_video(t):
    """Three videos of six keyframes each, and two more rows."""
    return ranking.spread_per_video(ranked(t), t.features, 20, 3).select(F.col("place").cast("long").alias("place"), "video_id", "frame_idx")


@query(f"{_POOL}, x AS (SELECT rank, video_id, global_id // 40 AS ev FROM pool) SELECT rank, video_id, ev FROM x QUALIFY row_number() OVER (PARTITION BY video_id, ev ORDER BY rank) = 1")
def dedup_sequence(t):
    x = ranked(t).withColumn("events", F.expr("global_id div 40"))
    return ranking.dedup_sequence(x).select(F.col("rank").cast("long").alias("rank"), "video_id", F.col("events").alias("ev"))


@query(f"WITH {FRAMES}, {sim()}, {pool(60)}, x AS (SELECT rank, video_id, CAST(frame_idx AS VARCHAR) AS events FROM pool UNION ALL SELECT r, (SELECT video_id FROM pool WHERE rank = 1), ((r - 1) * 100) || '-' || ((r - 1) * 100 + 400) || '-' || ((r - 1) * 100 + 800) FROM range(61, 101) g(r)) SELECT rank, video_id, events FROM x")
def pad_to_k(t):
    x = ranked(t, 60).withColumn("events", F.array("frame_idx"))
    return ranking.pad_to(x, 100).select("rank", "video_id", F.array_join(F.col("events").cast("array<string>"), "-").alias("events"))


@query(f"WITH {FRAMES}, {sim()}, {pool(100)}, w AS (SELECT min(rank) AS m FROM pool WHERE global_id % 9 = 4) SELECT global_id, row_number() OVER (ORDER BY rank = m DESC, rank) AS place, round(CASE WHEN rank = m THEN (SELECT max(s) FROM pool) + 0.1::DOUBLE ELSE s END, 6) AS score FROM pool, w")
def promote_to_rank1(t):
    return ranking.promote(ranked(t, 100), F.col("global_id") % 9 == 4).select("global_id", F.col("place").cast("long").alias("place"), r6("score"))


@query(f"WITH {FRAMES}, {sim()}, {pool(3)}, a AS (SELECT video_id, min(rank) AS rank FROM pool GROUP BY 1), b AS (SELECT video_id, row_number() OVER (ORDER BY video_id) AS rank FROM (SELECT DISTINCT video_id FROM frames)), x AS (SELECT *, 0 AS late FROM a UNION ALL SELECT *, 1 FROM b WHERE video_id NOT IN (SELECT video_id FROM a)) SELECT video_id, row_number() OVER (ORDER BY late, rank, video_id) AS place FROM x QUALIFY place <= 8")
def candidate_topup(t):
    a = ranked(t, 3).groupBy("video_id").agg(F.min("rank").alias("rank"))
    b = t.features.select("video_id").distinct().withColumn("rank", F.row_number().over(Window.orderBy("video_id")))
    return ranking.top_up(a, b, 8).select("video_id", F.col("place").cast("long").alias("place"))


_G = f"{PREDICTED}, graded AS (SELECT p.query_id, p.rank, p.video_id, p.frame_idx, t.true_video, t.start_frame, t.end_frame, CASE WHEN p.video_id = t.true_video AND p.frame_idx BETWEEN t.start_frame AND t.end_frame THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r, rank % 2 = 1 AS match FROM predicted p JOIN truth t USING (query_id))"
_R = f"{_G}, atk AS (SELECT query_id, " + ", ".join(f"coalesce(max(r) FILTER (WHERE rank <= {k}), 0.0::DOUBLE) AS r_{k}" for k in E.DEPTHS) + " FROM graded GROUP BY 1), fin AS (SELECT *, (r_1 + r_5 + r_20 + r_50 + r_100) / 5 AS final FROM atk)"


def _truth(t):
    return t.ground_truth.withColumnRenamed("video_id", "true_video")


def graded(t):
    p = t.predictions.join(F.broadcast(_truth(t)), "query_id")  # a row a query
    p = p.withColumn("match", F.col("rank") % 2 == 1)  # whether the answer is right, of questions
    return p.withColumn("r", E.r_kis(F.col("video_id"), F.col("true_video"), F.col("frame_idx"), F.col("start_frame"), F.col("end_frame")))


@query(f"WITH {_G} SELECT query_id, rank, greatest(start_frame - frame_idx, 0, frame_idx - end_frame) AS distance FROM graded WHERE video_id = true_video")
def frame_distance(t):
    return graded(t).where("video_id = true_video").select("query_id", F.col("rank").cast("long").alias("rank"), E.frame_distance(F.col("frame_idx"), F.col("start_frame"), F.col("end_frame")).alias("distance"))


@query(f"WITH {_G} SELECT query_id, rank, r FROM graded")
def r_score_kis(t):
    return graded(t).select("query_id", F.col("rank").cast("long").alias("rank"), "r")


@query(f"WITH {_G} SELECT query_id, rank, CASE WHEN r > 0 AND (rank % 4 = 0 OR rank % 2 = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM graded")
def r_score_qa(t):
    match = F.when(F.col("rank") % 4 == 0, F.lit(None).cast("boolean")).otherwise(answers_match(F.lit("Blue car"), F.when(F.col("rank") % 2 == 1, F.lit("the CAR is blue!")).otherwise(F.lit("white"))))
    r = E.r_qa(F.col("video_id"), F.col("true_video"), F.col("frame_idx"), F.col("start_frame"), F.col("end_frame"), match)
    return graded(t).select("query_id", F.col("rank").cast("long").alias("rank"), r.alias("r"))


@query(f"""WITH {PREDICTED} SELECT p.query_id, p.rank, CASE WHEN p.video_id = t.true_video THEN round((CASE WHEN p.frame_idx BETWEEN e1 - 25 AND e1 + 25 THEN 1 ELSE 0 END + CASE WHEN p.frame_idx + 500 BETWEEN e2 - 25 AND e2 + 25 THEN 1 ELSE 0 END) / 3.0::DOUBLE, 6) ELSE 0.0::DOUBLE END AS r FROM predicted p JOIN truth t USING (query_id)""")
def r_score_trake(t):
    p = t.predictions.join(F.broadcast(_truth(t)), "query_id")
    ev = [F.col(f"e{i}") for i in (1, 2, 3)]
    r = E.r_trake(F.col("video_id"), F.col("true_video"), F.array(F.col("frame_idx"), F.col("frame_idx") + 500), F.array(*[e - 25 for e in ev]), F.array(*[e + 25 for e in ev]))
    return p.select("query_id", F.col("rank").cast("long").alias("rank"), F.round(r, 6).alias("r"))


@query(f"WITH {_R} SELECT query_id, r_1, r_5, r_20, r_50, r_100, round(final, 6) AS final FROM fin")
def r_at_k_final(t):
    return E.r_at_k(graded(t)).select("query_id", *[f"r_{k}" for k in E.DEPTHS], r6("final"))


_D = f"""{_R}, vo AS (SELECT query_id, video_id, true_video, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS video_rank FROM graded GROUP BY query_id, video_id, true_video), vr AS (SELECT query_id, video_rank FROM vo WHERE video_id = true_video),
di AS (SELECT query_id, min(greatest(start_frame - frame_idx, 0, frame_idx - end_frame)) AS least_distance, bool_or(frame_idx BETWEEN start_frame AND end_frame AND NOT match AND rank <= 20) AS mismatch FROM graded WHERE video_id = true_video GROUP BY 1),
fh AS (SELECT query_id, min(rank) FILTER (WHERE r > 0) AS first_hit, min(rank) FILTER (WHERE r >= 1) AS first_perfect FROM graded GROUP BY 1),
det AS (SELECT fin.*, video_rank, coalesce(1.0::DOUBLE / video_rank, 0.0) AS mrr, least_distance, first_hit, CASE WHEN video_rank IS NULL THEN 'VIDEO_NOT_IN_TOP100' WHEN video_rank > 20 THEN 'VIDEO_LATE (>Top20)' WHEN first_perfect = 1 THEN 'PERFECT_RANK_1' WHEN first_perfect <= 5 THEN 'PERFECT_IN_TOP5'
 WHEN first_hit IS NOT NULL THEN 'PARTIAL_HIT' WHEN least_distance <= 25 THEN 'TEMPORAL_NEAR_MISS (<=25f)' WHEN mismatch THEN 'QA_ANSWER_MISMATCH' ELSE 'FRAME_MISS' END AS error FROM fin LEFT JOIN vr USING (query_id) LEFT JOIN di USING (query_id) LEFT JOIN fh USING (query_id))"""


def _details(t):
    return E.details(graded(t).select("query_id", "rank", "video_id", "frame_idx", "r", "match"), _truth(t).select("query_id", "true_video", "start_frame", "end_frame"))


@query(f"WITH {_D} SELECT query_id, video_rank, round(mrr, 6) AS mrr, first_hit, least_distance FROM det")
def video_rank_mrr_recall(t):
    return _details(t).select("query_id", F.col("video_rank").cast("long").alias("video_rank"), r6("mrr"), F.col("first_hit").cast("long").alias("first_hit"), "least_distance")


@query(f"WITH {_D} SELECT query_id, error FROM det")
def error_taxonomy(t):
    return _details(t).select("query_id", "error")


@query(f"WITH {_D} SELECT error, count(*) AS n FROM det GROUP BY 1")
def error_counts(t):
    return _details(t).groupBy("error").agg(F.count("*").alias("n"))


@query(f"WITH {_D} SELECT query_id, coalesce(least_distance BETWEEN 1 AND 5, false) AS near_5, coalesce(least_distance BETWEEN 1 AND 25, false) AS near_25 FROM det")
def near_miss(t):
    d = F.col("least_distance")
    return _details(t).select("query_id", F.coalesce(d.between(1, 5), F.lit(False)).alias("near_5"), F.coalesce(d.between(1, 25), F.lit(False)).alias("near_25"))


@query(f"WITH {_R} SELECT CASE WHEN round(final, 1) >= 0.95 THEN '1.0' WHEN round(final, 1) >= 0.75 THEN '0.8' WHEN round(final, 1) >= 0.55 THEN '0.6' WHEN round(final, 1) >= 0.35 THEN '0.4' WHEN round(final, 1) >= 0.15 THEN '0.2' ELSE '0.0' END AS bucket, count(*) AS n FROM fin GROUP BY 1")
def score_buckets(t):
    return E.r_at_k(graded(t)).groupBy(E.score_bucket(F.col("final")).alias("bucket")).agg(F.count("*").alias("n"))


_TASK = "CASE WHEN query_id < 'q-V005' THEN 'kis' ELSE 'qa' END"


@query(f"WITH {_D}, k AS (SELECT *, {_TASK} AS task_type FROM det) SELECT coalesce(task_type, 'all') AS task_type, count(*) AS n, round(avg(final), 6) AS final, round(avg(r_100), 6) AS r_100, round(avg(mrr), 6) AS mrr, round(avg(CASE WHEN coalesce(video_rank, 999999) <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS video_r_5 FROM k GROUP BY ROLLUP (task_type)")
def macro_summary(t):
    k = _details(t).withColumn("task_type", F.when(F.col("query_id") < "q-V005", "kis").otherwise("qa"))
    return E.summary(k).select("task_type", "n", r6("final"), r6("r_100"), r6("mrr"), r6("video_r_5"))


@query(f"WITH {_R}, k AS (SELECT *, {_TASK} AS task_type FROM fin) SELECT task_type, count(*) AS n, round(avg(final), 6) AS final, round(avg(r_1), 6) AS r_1, round(avg(r_100), 6) AS r_100 FROM k GROUP BY 1")
def task_summary(t):
    k = E.r_at_k(graded(t)).withColumn("task_type", F.when(F.col("query_id") < "q-V005", "kis").otherwise("qa"))
    return k.groupBy("task_type").agg(F.count("*").alias("n"), F.round(F.avg("final"), 6).alias("final"), F.round(F.avg("r_1"), 6).alias("r_1"), F.round(F.avg("r_100"), 6).alias("r_100"))


@query(f"WITH {TRUTH} SELECT query_id, CASE WHEN greatest(1, end_frame - start_frame + 1) <= 30 THEN 'SHORT' WHEN greatest(1, end_frame - start_frame + 1) <= 120 THEN 'MEDIUM' ELSE 'LONG' END AS category FROM truth")
def window_category(t):
    return t.ground_truth.select("query_id", E.window_category(F.col("start_frame"), F.col("end_frame")).alias("category"))


_NORM = "regexp_replace(regexp_replace(trim(lower(coalesce({}, ''))), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')"


@query(f"SELECT doc_id, {_NORM.format('text')} AS answer FROM documents")
def normalize_answers(t):
    return t.read("documents").select("doc_id", normalize_answer(F.col("text")).alias("answer"))


_CORE = "list_distinct(list_filter(string_split({}, ' '), lambda w: w <> '' AND w NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")))"
_SAID = "CASE doc_id % 6 WHEN 0 THEN upper(source) || '!' WHEN 1 THEN lang WHEN 2 THEN 'màu ' || coalesce(source, '') || ' xanh' WHEN 3 THEN 'xanh đậm' WHEN 4 THEN 'tháp cao, màu xanh' ELSE ' ' END"
_TRUE = "CASE WHEN doc_id % 6 < 3 THEN source WHEN doc_id % 6 = 3 THEN 'màu xanh' ELSE 'người xanh ở tháp' END"
_FAST = f"SELECT doc_id, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a) OR (least(len(x), len(y)) > 0 AND (len(list_intersect(x, y)) >= 2 OR (least(len(x), len(y)) = 1 AND len(list_intersect(x, y)) = 1)))) AS fast FROM (SELECT doc_id, a, b, {_CORE.format('a')} AS x, {_CORE.format('b')} AS y FROM (SELECT doc_id, {_NORM.format(_TRUE)} AS a, {_NORM.format(_SAID)} AS b FROM documents))"


@query(f"SELECT doc_id, fast FROM ({_FAST})")
def qa_fast_match(t):
    k = F.col("doc_id") % 6
    said = F.when(k == 0, F.concat(F.upper("source"), F.lit("!"))).when(k == 1, F.col("lang")).when(k == 2, F.concat(F.lit("màu "), F.coalesce("source", F.lit("")), F.lit(" xanh"))).when(k == 3, "xanh đậm").when(k == 4, "tháp cao, màu xanh").otherwise(" ")
    truth = F.when(k < 3, F.col("source")).when(k == 3, "màu xanh").otherwise("người xanh ở tháp")
    return t.read("documents").select("doc_id", answers_match(truth, said).alias("fast"))


@query(f"SELECT doc_id, fast OR coalesce(l.quality = 1, false) AS judged FROM ({_FAST}) f LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def qa_judge_cached(t):
    cache = t.read("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return qa_fast_match(t).join(cache, "doc_id", "left").select("doc_id", (F.col("fast") | F.coalesce(F.col("quality") == 1, F.lit(False))).alias("judged"))


@query("SELECT user_id, event_type, event_id, round(CAST(value AS DOUBLE), 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_keep_last(t):
    e = t.read("events").select("user_id", "event_type", "ts", "event_id", F.col("value").cast("double").alias("value"))
    return quality.upsert_keep_last(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


_LINES = """lines AS (SELECT 'f' || (o_orderkey // 64) AS file, o_orderkey AS row_no, CASE o_orderkey % 7 WHEN 0 THEN 'kis' WHEN 1 THEN 'trake' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'kis' ELSE 'qa' END END AS task,
CASE WHEN o_orderkey // 64 % 5 <> 0 THEN 'V001,' || (o_orderkey % 1000) || CASE WHEN o_orderkey % 7 > 1 AND o_orderkey % 2 = 1 THEN ',"yes"' ELSE '' END ELSE CASE o_orderkey % 7 WHEN 0 THEN 'video,frame' WHEN 1 THEN 'V001.mp4,5' WHEN 2 THEN 'V001,-4,"x"' WHEN 3 THEN 'V001,7' WHEN 4 THEN 'V002,12,""' WHEN 5 THEN 'V003,1,"ok"' ELSE 'V004,abc' END END AS line FROM orders)"""


_VALIDATED = f"""WITH {_LINES}, e AS (SELECT *, split_part(line, ',', 1) AS v, string_split(line, ',') AS p, CASE WHEN task = 'trake' THEN list_slice(string_split(line, ','), 2, NULL) ELSE list_slice(string_split(line, ','), 2, 2) END AS fr, regexp_extract(line, '^[^,]*,[^,]*,"?(.*?)"?$', 1) AS an FROM lines),
c AS (SELECT *, CASE WHEN starts_with(lower(line), 'video') THEN 'HEADER' WHEN trim(v) = '' THEN 'NO_VIDEO' WHEN ends_with(lower(v), '.mp4') THEN 'EXTENSION' WHEN (task = 'kis' AND len(p) <> 2) OR (task = 'qa' AND len(p) < 3) OR (task = 'trake' AND len(p) < 2) THEN 'COLUMNS'
WHEN len(list_filter(fr, lambda x: NOT regexp_full_match(trim(x), '-?[0-9]+'))) > 0 THEN 'FRAME' WHEN len(list_filter(fr, lambda x: starts_with(trim(x), '-'))) > 0 THEN 'NEGATIVE' WHEN task = 'qa' AND trim(an) = '' THEN 'NO_ANSWER' WHEN task = 'qa' AND length(an) > 100 THEN 'LONG_ANSWER' END AS err FROM e)
SELECT file, count(*) AS rows, coalesce(CASE WHEN count(*) > 100 THEN 'TOO_MANY_ROWS' ELSE arg_min(err, row_no) FILTER (WHERE err IS NOT NULL) END, '') AS error, coalesce(CASE WHEN count(*) > 100 THEN 'TOO_MANY_ROWS' ELSE arg_min(err, row_no) FILTER (WHERE err IS NOT NULL) END, '') = '' AS valid FROM c GROUP BY 1"""


@query(_VALIDATED)
def validate_submission(t):
    k = F.col("o_orderkey")
    task = F.when(k % 7 == 0, "kis").when(k % 7 == 1, "trake").when(k % 2 == 0, "kis").otherwise("qa")
    good = F.concat(F.lit("V001,"), (k % 1000).cast("string"), F.when((k % 7 > 1) & (k % 2 == 1), ',"yes"').otherwise(""))
    bad = F.element_at(F.array(*[F.lit(x) for x in ("video,frame", "V001.mp4,5", 'V001,-4,"x"', "V001,7", 'V002,12,""', 'V003,1,"ok"', "V004,abc")]), (k % 7 + 1).cast("int"))
    lines = t.read("orders").select(F.concat(F.lit("f"), F.expr("o_orderkey div 64").cast("string")).alias("file"), k.alias("row_no"), task.alias("task"), F.when(F.expr("o_orderkey div 64 % 5") != 0, good).otherwise(bad).alias("line"))
    return quality.validate(lines)


@query("SELECT doc_id, in_a, in_b FROM (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(x, 0) AS in_a, coalesce(y, 0) AS in_b FROM (SELECT doc_id, count(*) AS x FROM documents GROUP BY 1) d FULL OUTER JOIN (SELECT doc_id, count(*) AS y FROM labels GROUP BY 1) l USING (doc_id)) WHERE in_a <> in_b")
def set_equality_audit(t):
    return quality.count_differences(t.read("documents"), t.read("labels"), "doc_id")


@query("SELECT d.source, count(*) AS docs, count(l.doc_id) AS labelled, count(*) FILTER (WHERE d.text IS NULL) AS null_texts FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def coverage_audit(t):
    has = t.read("labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    return t.read("documents").join(has, "doc_id", "left").groupBy("source").agg(F.count("*").alias("docs"), F.count("has").alias("labelled"), F.count_if(F.col("text").isNull()).alias("null_texts"))


@query(f"WITH {FRAMES}, {OCR}, o AS (SELECT global_id, global_id * 50 + doc_id % 2 AS frame_idx FROM ocr) SELECT count(*) AS rows, count(f.global_id) AS matched, count(*) FILTER (WHERE f.frame_idx = o.frame_idx) AS equal_frame, max(abs(f.frame_idx - o.frame_idx)) AS jitter FROM o LEFT JOIN frames f USING (global_id)")
def ocr_frame_consistency(t):
    o = t.ocr.select("global_id", (F.col("global_id") * 50 + F.col("doc_id") % 2).alias("o_frame"))
    j = o.join(t.features.select("global_id", "frame_idx", F.lit(1).alias("has")), "global_id", "left")
    return j.agg(F.count("*").alias("rows"), F.count("has").alias("matched"), F.count_if(F.col("frame_idx") == F.col("o_frame")).alias("equal_frame"), F.max(F.abs(F.col("frame_idx") - F.col("o_frame"))).alias("jitter"))


@query(f"WITH {TRANSCRIPTS} SELECT count(*) AS n, count(*) FILTER (WHERE start_ms >= end_ms) AS reversed, count(*) FILTER (WHERE start_ms < 0) AS negative, round(avg(length(transcript)), 4) AS mean_length, round(sum(end_ms - start_ms) / 3600000.0::DOUBLE, 4) AS hours FROM transcripts")
def asr_sanity(t):
    s = t.transcripts
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("start_ms") >= F.col("end_ms")).alias("reversed"), F.count_if(F.col("start_ms") < 0).alias("negative"), F.round(F.avg(F.char_length("transcript")), 4).alias("mean_length"), F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 3600000.0, 4).alias("hours"))


@query("SELECT conv_id, bool_and(coalesce(n > prev, true)) AS increasing FROM (SELECT conv_id, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1")
def monotonic_check(t):
    c = t.read("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.char_length("text").alias("n")))).alias("a"))
    return c.select("conv_id", quality.strictly_increasing(F.transform("a", lambda x: x["n"])).alias("increasing"))


@query("SELECT row_number() OVER (ORDER BY batch, label, vec_id) - 1 AS global_id, vec_id, batch FROM (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS batch FROM embeddings)")
def merge_batches(t):
    e = t.read("embeddings").select(F.lit(0).alias("global_id"), "vec_id", "label")
    m = quality.merge_batches([e.where("vec_id % 3 <> 0"), e.where("vec_id % 3 = 0")], ["batch", "label", "vec_id"])
    return m.select(F.col("global_id").cast("long").alias("global_id"), "vec_id", F.col("batch").cast("int").alias("batch"))


@query(f"WITH {FRAMES}, {sim()}, {pool(100)}, c AS (SELECT video_id, frame_idx FROM pool WHERE rank = 40), x AS (SELECT 0 AS o, 40 AS rank, * FROM c UNION ALL SELECT 1, rank, video_id, frame_idx FROM pool WHERE rank <> 40) SELECT row_number() OVER (ORDER BY o, rank) AS rank, video_id, frame_idx FROM x")
def manual_override(t):
    p = ranked(t, 100).select("query_id", "rank", "video_id", "frame_idx")
    return quality.override(p, p.where("rank = 40")).select(F.col("rank").cast("long").alias("rank"), "video_id", "frame_idx")


@query(f"WITH {FRAMES}, g AS (SELECT global_id, video_id, frame_idx, greatest(coalesce(frame_idx - lag(frame_idx) OVER w, 0), coalesce(lead(frame_idx) OVER w - frame_idx, 0)) >= 75 AS large FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)), {sim()} SELECT global_id, CASE WHEN s >= 0.75 AND NOT large THEN 'no' WHEN large THEN 'gap' WHEN s < 0.70 AND global_id % 2 = 0 THEN 'ask' ELSE 'no' END AS decision FROM g JOIN sim USING (global_id)")
def blind_spot_decision(t):
    g = temporal.keyframe_gap(search.with_similarity(t.features, t.vector(7)).drop("embedding"))
    d = F.when((F.col("s") >= 0.75) & ~F.col("large"), "no").when(F.col("large"), "gap").when((F.col("s") < 0.70) & (F.col("global_id") % 2 == 0), "ask").otherwise("no")
    return g.select("global_id", d.alias("decision"))


@query(f"WITH {FRAMES}, {TRANSCRIPTS} SELECT conv_id, turn, coalesce((SELECT min(abs(f.pts_ms - s.start_ms)) FROM frames f WHERE f.video_id = s.video_id) > 800, true) AS blind FROM transcripts s")
def asr_blind_spot_check(t):
    marks = t.transcripts.select(F.struct("conv_id", "turn").alias("global_id"), "video_id", F.col("start_ms").alias("pts_ms"))
    near = temporal.nearest_segment(marks, t.features.select("video_id", F.col("pts_ms").alias("start_ms")))
    return near.select("global_id.conv_id", "global_id.turn", F.coalesce(F.abs(F.col("start_ms") - F.col("pts_ms")) > 800, F.lit(True)).alias("blind"))


@query("WITH c AS (SELECT event_id % 7 AS persons, event_id % 6 AS said FROM events) SELECT persons, said, CASE WHEN persons = said THEN 0.5::DOUBLE WHEN abs(persons - said) = 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS bonus, count(*) AS n FROM c GROUP BY ALL")
def object_person_match(t):
    text = F.concat(F.lit("there are "), (F.col("event_id") % 6).cast("string"), F.lit(" people here"))
    said = F.regexp_extract(text, r"(\d+)\s+(people|persons|men|women|người)", 1).cast("long")
    persons = F.col("event_id") % 7
    bonus = F.when(persons == said, 0.5).when(F.abs(persons - said) == 1, 0.2).otherwise(0.0)
    return t.read("events").select(persons.alias("persons"), said.alias("said"), bonus.alias("bonus")).groupBy("persons", "said", "bonus").agg(F.count("*").alias("n"))


@query(f"WITH f AS ({_VALIDATED}) SELECT split_part(file, 'f', 2)::BIGINT % 5 AS folder, count(*) AS files, count(*) FILTER (WHERE valid) AS valid_files, bool_and(valid) AS all_valid FROM f GROUP BY 1")
def validate_directory(t):
    """Every file of validate_submission, in five folders; a folder is valid if all its files are."""
    files = validate_submission(t).withColumn("folder", F.substring("file", 2, 20).cast("long") % 5)
    return quality.validate_folders(files, ["folder"])


@query(f"WITH {FRAMES} SELECT global_id, pts_time FROM frames WHERE pts_time BETWEEN 100 AND 300")
def time_window_filter(t):
    return t.features.select("global_id", (F.col("pts_ms") / 1000.0).alias("pts_time")).where(F.col("pts_time").between(100, 300))


@query(f"WITH {FRAMES} SELECT global_id, video_id FROM frames WHERE contains(lower(video_id), 'v00')")
def video_filter_contains(t):
    return t.features.select("global_id", "video_id").where(F.lower("video_id").contains("v00"))


@query("SELECT conv_id, turn FROM conversations WHERE length(trim(text)) > 2")
def asr_min_len(t):
    return t.read("conversations").where(F.length(F.trim("text")) > 2).select("conv_id", "turn")


@query("SELECT event_id, w, h FROM (SELECT event_id, event_type, event_id % 40 AS w, event_id % 30 AS h FROM events) WHERE w >= 14 AND h >= 12 AND length(trim(event_type)) >= 2")
def min_box_filter(t):
    boxes = t.read("events").select("event_id", (F.col("event_id") % 100).alias("x1"), (F.col("event_id") % 100 + F.col("event_id") % 40).alias("x2"), F.lit(5).alias("y1"), (F.col("event_id") % 30 + 5).alias("y2"), "event_type")
    return quality.readable_boxes(boxes, "event_type").select("event_id", "w", "h")


@query("SELECT item_id, CASE WHEN len(regexp_split_to_array(trim(text), '\\s+')) > 35 THEN 'scene' ELSE 'text' END AS used FROM benchmark")
def long_query_switch(t):
    return t.read("benchmark").select("item_id", F.when(F.size(F.split(F.trim("text"), r"\s+")) > 35, "scene").otherwise("text").alias("used"))


@query(f"WITH {FRAMES}, {sim()} SELECT global_id, row_number() OVER (PARTITION BY video_id ORDER BY s DESC, global_id) AS rank FROM sim")
def rank_assign(t):
    w = Window.partitionBy("video_id").orderBy(F.desc("s"), "global_id")
    return search.with_similarity(t.features, t.vector(7)).select("global_id", F.row_number().over(w).cast("long").alias("rank"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_upsert(t):
    """upsert_keep_last as a stream over the events table, in two versions of a table in the shared folder."""
    import uuid

    from keymoment.streaming import upsert

    events = t.read("events").select("user_id", "event_type", "ts", "event_id")
    base = f"{t.shared}/{t.spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    events.repartition(4).write.parquet(f"{base}/log")
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/log")
    upsert.keep_last_stream(stream, ["user_id", "event_type"], ["ts", "event_id"], f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return upsert.latest(t.spark, f"{base}/table").select("user_id", "event_type", "event_id")
