"""Queries of vector search, sources and windows over similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keymoment.functions.vectors import blend, dot, l2_normalize, vector
from keymoment.operators import align, ranking, search, temporal
from keymoment.plans.registry import FRAMES, dot_sql, pool, query, sim

EVENTS = (3, 42, 99)
r6 = lambda c: F.round(c, 6).alias(c)
WITH = f"WITH {FRAMES}, {sim()}"
E3 = f"""WITH {FRAMES}, ev AS (SELECT f.video_id, f.pts_ms, f.frame_idx, {', '.join(f"{dot_sql('f.embedding', f'q{i}.embedding')} AS e{i}" for i in (1, 2, 3))} FROM frames f,
  {', '.join(f'(SELECT embedding FROM embeddings WHERE vec_id = {v}) q{i}' for i, v in enumerate(EVENTS, 1))})"""


def similar(t, vec: int = 7):
    return search.with_similarity(t.features, t.vector(vec))


def events(t):
    return search.with_similarities(t.features, {f"e{i}": t.vector(v) for i, v in enumerate(EVENTS, 1)})


@query(f"WITH {FRAMES} SELECT global_id, video_id, CAST(keyframe_index AS INTEGER) AS keyframe_index, pts_time, frame_idx FROM frames")
def scan_frames(t):
    return t.frames.select("global_id", "video_id", "keyframe_index", "pts_time", "frame_idx")


@query(f"SELECT vec_id AS global_id, round({dot_sql('n', 'n')}, 6) AS length, round(n[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt({dot_sql('embedding', 'embedding')})) AS n FROM embeddings)")
def l2_normalize_vectors(t):
    n = l2_normalize(F.col("embedding"))
    return t.features.select("global_id", n.alias("n")).select("global_id", F.round(dot(F.col("n"), F.col("n")), 6).alias("length"), F.round(F.col("n")[0], 6).alias("first"))


@query(f"{WITH} SELECT global_id, video_id, row_number() OVER (ORDER BY s DESC, global_id) AS rank, round(s, 6) AS s FROM sim QUALIFY rank <= 100")
def knn_exact(t):
    return search.knn_exact(t.features, t.vector(7), 100).select("global_id", "video_id", F.col("rank").cast("long").alias("rank"), r6("s"))


@query(f"WITH {FRAMES} SELECT 'e' || q.vec_id AS query_id, f.global_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {dot_sql('f.embedding', 'q.embedding')} DESC, f.global_id) AS rank FROM frames f, embeddings q WHERE q.vec_id IN (3, 42, 99) QUALIFY rank <= 50")
def knn_batch(t):
    return search.knn_batch(t.features, t.vectors(EVENTS), 50).select("query_id", "global_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {FRAMES}, m AS (SELECT list_transform(list_zip(a.embedding, b.embedding), lambda z: 0.7::DOUBLE * z[1] + 0.3::DOUBLE * z[2]) AS v FROM (SELECT embedding FROM embeddings WHERE vec_id = 7) a, (SELECT embedding FROM embeddings WHERE vec_id = 11) b),
q AS (SELECT list_transform(v, lambda x: x / sqrt({dot_sql('v', 'v')})) AS v FROM m)
SELECT global_id, row_number() OVER (ORDER BY {dot_sql('f.embedding', 'q.v')} DESC, global_id) AS rank FROM frames f, q QUALIFY rank <= 100""")
def dual_embedding(t):
    one = t.spark.range(1).select(blend(vector(t.vector(7)), vector(t.vector(11)), 0.7, 0.3).alias("v")).first()["v"]
    return search.knn_exact(t.features, list(one), 100).select("global_id", F.col("rank").cast("long").alias("rank"))


@query(f"{WITH}, b AS (SELECT video_id, max(s) AS best FROM sim GROUP BY 1) SELECT video_id, round(sum(exp((s - best) / 0.05::DOUBLE) * s) / sum(exp((s - best) / 0.05::DOUBLE)), 6) AS pooled, round(0.7::DOUBLE * sum(exp((s - best) / 0.05::DOUBLE) * s) / sum(exp((s - best) / 0.05::DOUBLE)) + 0.3::DOUBLE * max(best), 6) AS mixed FROM sim JOIN b USING (video_id) GROUP BY 1")
def softmax_pool_video_score(t):
    return search.softmax_pool(similar(t)).select("video_id", r6("pooled"), r6("mixed"))


@query(f"""WITH q AS (SELECT {dot_sql('q.embedding', 'p.embedding')} AS c, p.vec_id AS m FROM embeddings q, embeddings p WHERE q.vec_id = 7 AND p.vec_id IN (0, 1, 2))
SELECT 'm' || m AS modality, round(exp(c / 0.5::DOUBLE) / sum(exp(c / 0.5::DOUBLE)) OVER (), 6) AS weight FROM q""")
def prototype_gating(t):
    q = vector(t.vector(7))
    w = search.softmax([dot(q, vector(t.vector(i))) for i in range(3)], 0.5)
    return t.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(f"m{i}").alias("modality"), F.round(x, 6).alias("weight")) for i, x in enumerate(w)])).alias("x")).select("x.*")


@query(f"{WITH} SELECT video_id, round(avg(s), 6) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s DESC, global_id) AS r FROM sim) WHERE r <= 3 GROUP BY 1")
def global_top3_mean(t):
    return search.top_mean(similar(t)).select("video_id", r6("top_mean"))


@query(f"{WITH} SELECT video_id, arg_max(frame_idx, s) AS frame_idx, round(min(s), 6) AS least, round(max(s), 6) AS most, round(avg(s), 6) AS mean FROM sim WHERE frame_idx BETWEEN 1000 AND 9000 AND (frame_idx - 1000) % 100 = 0 GROUP BY 1")
def dense_refine_argmax(t):
    return search.refine_argmax(similar(t), 1000, 9000, 100).select("video_id", "frame_idx", r6("least"), r6("most"), r6("mean"))


@query(f"""{WITH}, {pool()}, near AS (SELECT *, coalesce(greatest(max(s) OVER (PARTITION BY video_id ORDER BY pts_ms RANGE BETWEEN 30000 PRECEDING AND 1 PRECEDING),
  max(s) OVER (PARTITION BY video_id ORDER BY pts_ms RANGE BETWEEN 1 FOLLOWING AND 30000 FOLLOWING)), s) AS neighbor FROM pool) SELECT global_id, round(s, 6) AS s, round(neighbor, 6) AS neighbor FROM near""")
def neighbor_max(t):
    return temporal.neighbor_max(search.knn_exact(t.features, t.vector(7), 200)).select("global_id", r6("s"), r6("neighbor"))


@query(f"""{WITH} SELECT a.video_id, a.global_id, round(sum(w * b.s) / sum(w), 5) AS smooth FROM (SELECT a.video_id, a.global_id, b.s, exp(0 - ((a.pts_ms - b.pts_ms) / 1000.0::DOUBLE) * ((a.pts_ms - b.pts_ms) / 1000.0::DOUBLE) / 32) AS w FROM sim a JOIN sim b USING (video_id)) b JOIN sim a ON a.global_id = b.global_id GROUP BY ALL""")
def gaussian_smooth(t):
    return temporal.gaussian_smooth(similar(t), 4.0).select("video_id", "global_id", F.round("smooth", 5).alias("smooth"))


@query(f"{WITH} SELECT global_id, round(0.2::DOUBLE * coalesce(lag(s) OVER w, s) + 0.6::DOUBLE * s + 0.2::DOUBLE * coalesce(lead(s) OVER w, s), 6) AS smooth FROM sim WINDOW w AS (PARTITION BY video_id ORDER BY pts_ms)")
def three_point_smooth(t):
    return temporal.three_point_smooth(similar(t)).select("global_id", r6("smooth"))


@query(f"{WITH} SELECT global_id, round(CASE WHEN max(s) OVER w - min(s) OVER w > 1e-6 THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE s END, 6) AS norm FROM sim WINDOW w AS (PARTITION BY video_id)")
def row_minmax_norm(t):
    return temporal.minmax_norm(similar(t), "s", ("video_id",)).select("global_id", r6("norm"))


@query(f"""WITH {FRAMES}, {sim('a', 5)}, {sim('b', 17)} SELECT a.global_id, round((max(a.s) OVER w + max(b.s) OVER w) / 2, 6) AS coverage FROM a JOIN b USING (global_id) WINDOW w AS (PARTITION BY a.video_id ORDER BY a.pts_ms RANGE BETWEEN 6000 PRECEDING AND 6000 FOLLOWING)""")
def cue_window_coverage(t):
    f = search.with_similarities(t.features, {"c1": t.vector(5), "c2": t.vector(17)})
    return temporal.window_coverage(f, ["c1", "c2"]).select("global_id", r6("coverage"))


@query(f"""WITH {FRAMES}, f AS (SELECT video_id, list(frame_idx ORDER BY frame_idx) AS k, count(*) AS n FROM frames WHERE video_id <> 'V003' OR keyframe_index = 1 GROUP BY 1), a AS (SELECT video_id, x AS target FROM (SELECT DISTINCT video_id FROM frames UNION ALL SELECT 'VXXX'), (VALUES (0), (350), (12345), (1000000)) v(x)),
p AS (SELECT a.*, k, n, least(1 + len(list_filter(k, lambda x: x < target)), n) AS i FROM a LEFT JOIN f USING (video_id)),
g AS (SELECT video_id, target, CASE WHEN n >= 2 THEN greatest(target - k[greatest(i - 1, 1)], k[least(i + 1, n)] - target) ELSE 100 END AS gap, n FROM p) SELECT video_id, target, gap, gap / 25.0::DOUBLE AS seconds, CASE WHEN n >= 2 THEN gap >= 75 ELSE true END AS large FROM g""")
def keyframe_gap(t):
    """V003 is taken to have one keyframe, VXXX none."""
    f = t.frames.where("video_id <> 'V003' OR keyframe_index = 1").select("video_id", "frame_idx")
    at = t.features.select("video_id").distinct().unionByName(t.spark.range(1).select(F.lit("VXXX").alias("video_id"))).withColumn("target", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 350, 12345, 1_000_000)])))
    return temporal.gap_around(f, at)


@query(f"""WITH {FRAMES}, l AS (SELECT video_id, max(keyframe_index) AS last FROM frames GROUP BY 1), a AS (SELECT video_id, p, greatest(1, least(p - 2, last - 4)) AS first FROM l, (VALUES (1), (20), (1000)) v(p))
SELECT a.video_id, a.p AS position, f.keyframe_index AS keyframe_index, f.frame_idx FROM a JOIN frames f ON f.video_id = a.video_id AND f.keyframe_index BETWEEN a.first AND a.first + 4""")
def surrounding_keyframes(t):
    at = t.features.select("video_id").distinct().withColumn("position", F.explode(F.array(F.lit(1), F.lit(20), F.lit(1000))))
    return temporal.surrounding(t.frames.drop("embedding"), at).select("video_id", "position", F.col("keyframe_index").cast("long").alias("keyframe_index"), "frame_idx")


@query(f"""{WITH}, p1 AS (SELECT video_id, arg_max(pts_ms, s) AS t, max(s) AS v FROM sim GROUP BY 1),
p2 AS (SELECT s.video_id, arg_max(s.pts_ms, s.s) AS t, max(s.s) AS v FROM sim s JOIN p1 USING (video_id) WHERE abs(s.pts_ms - p1.t) > 2000 GROUP BY 1),
p3 AS (SELECT s.video_id, max(s.s) AS v FROM sim s JOIN p1 USING (video_id) JOIN p2 USING (video_id) WHERE abs(s.pts_ms - p1.t) > 2000 AND abs(s.pts_ms - p2.t) > 2000 GROUP BY 1)
SELECT p1.video_id, round(p1.v, 6) AS p1, round(coalesce(p2.v, p1.v), 6) AS p2, round(coalesce(p3.v, p2.v, p1.v), 6) AS p3 FROM p1 LEFT JOIN p2 USING (video_id) LEFT JOIN p3 USING (video_id)""")
def temporal_nms_peaks(t):
    return align.nms_peaks(similar(t)).select("video_id", r6("p1"), r6("p2"), r6("p3"))


_STEP = """d{i} AS (SELECT n.video_id, n.pts_ms, n.frame_idx, n.e3, n.e2, max(n.e{i} + p.dp - 0.001::DOUBLE * greatest(0, (n.pts_ms - p.pts_ms) / 1000.0::DOUBLE - 240)) AS dp,
  arg_max(p.path || '-' || n.frame_idx, p.dp - 0.001::DOUBLE * greatest(0, (n.pts_ms - p.pts_ms) / 1000.0::DOUBLE - 240)) AS path FROM ev n JOIN d{j} p ON p.video_id = n.video_id AND p.pts_ms < n.pts_ms GROUP BY ALL)"""


@query(f"""{E3}, d1 AS (SELECT *, e1 AS dp, CAST(frame_idx AS VARCHAR) AS path FROM ev), {_STEP.format(i=2, j=1)}, {_STEP.format(i=3, j=2)}
SELECT video_id, round(max(dp), 6) AS total, arg_max(path, dp) AS path FROM d3 GROUP BY 1""")
def monotonic_dp(t):
    return align.monotonic_dp(events(t), 3).select("video_id", r6("total"), F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


_RUNS = """r{i} AS (SELECT a.video_id, a.k AS first, b.k AS last, a.pts_ms AS t0, b.pts_ms AS t1, m.frame_idx AS mid, (SELECT avg(c.e{i}) FROM ix c WHERE c.video_id = a.video_id AND c.k BETWEEN a.k AND b.k) - 0.02::DOUBLE * (b.k - a.k) AS v
  FROM ix a JOIN ix b ON a.video_id = b.video_id AND b.k BETWEEN a.k AND a.k + 4 JOIN ix m ON m.video_id = a.video_id AND m.k = (a.k + b.k) // 2)"""
_RUN_DP = """g{i} AS (SELECT r.video_id, r.last, r.t1, max(r.v + p.dp - 0.001::DOUBLE * greatest(0, (r.t0 - p.t1) / 1000.0::DOUBLE - 240)) AS dp, arg_max(p.path || '-' || r.mid, r.v + p.dp - 0.001::DOUBLE * greatest(0, (r.t0 - p.t1) / 1000.0::DOUBLE - 240)) AS path FROM r{i} r JOIN g{j} p ON p.video_id = r.video_id AND p.last < r.first GROUP BY r.video_id, r.last, r.t1)"""


@query(f"""{E3}, ix AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pts_ms) AS k FROM ev), {_RUNS.format(i=1)}, {_RUNS.format(i=2)}, {_RUNS.format(i=3)},
g1 AS (SELECT video_id, last, t1, max(v) AS dp, arg_max(CAST(mid AS VARCHAR), v) AS path FROM r1 GROUP BY ALL), {_RUN_DP.format(i=2, j=1)}, {_RUN_DP.format(i=3, j=2)} SELECT video_id, round(max(dp), 6) AS total, arg_max(path, dp) AS path FROM g3 GROUP BY 1""")
def segmental_dp(t):
    return align.segmental_dp(events(t), 3).select("video_id", r6("total"), F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


_CAL = f"""{E3}, long AS (SELECT video_id, pts_ms, unnest([1, 2, 3]) AS event, unnest([e1, e2, e3]) AS s FROM ev), best AS (SELECT video_id, event, max(s) AS s FROM long GROUP BY ALL),
cal AS (SELECT video_id, event, (s - min(s) OVER w) / CASE WHEN max(s) OVER w - min(s) OVER w > 1e-6 THEN max(s) OVER w - min(s) OVER w ELSE 1 END AS p FROM best WINDOW w AS (PARTITION BY event))"""


def _calibrated(t):
    best = events(t).select("video_id", F.posexplode(F.array("e1", "e2", "e3")).alias("event", "s")).groupBy("video_id", "event").agg(F.max("s").alias("s"))
    return temporal.minmax_norm(best, "s", ("event",), "p", "one")


@query(f"{_CAL} SELECT video_id, event, round(p, 6) AS p FROM cal")
def minmax_calibration(t):
    return _calibrated(t).select("video_id", (F.col("event") + 1).alias("event"), r6("p"))


@query(f"""{_CAL}, {sim()}, top AS (SELECT video_id, avg(s) AS g FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s DESC, global_id) AS r FROM sim) WHERE r <= 3 GROUP BY 1)
SELECT video_id, round(0.4::DOUBLE * avg(p) + 0.3::DOUBLE * (-0.2::DOUBLE * ln(sum(exp(-5.0::DOUBLE * p)) + 1e-6)) + 0.3::DOUBLE * max(g), 6) AS coverage FROM cal JOIN top USING (video_id) GROUP BY 1""")
def event_coverage_score(t):
    return align.coverage_score(_calibrated(t), search.top_mean(similar(t))).select("video_id", r6("coverage"))


@query(f"""{E3}, d1 AS (SELECT *, e1 AS dp, CAST(frame_idx AS VARCHAR) AS path FROM ev), {_STEP.format(i=2, j=1)}, {_STEP.format(i=3, j=2)}, b AS (SELECT video_id, max(dp) AS total FROM d3 GROUP BY 1), {sim()},
g AS (SELECT video_id, avg(s) AS v FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s DESC, global_id) AS r FROM sim) WHERE r <= 3 GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY v DESC, video_id) AS v_rank FROM g) SELECT video_id, CAST(v_rank AS BIGINT) AS v_rank, round(3.0::DOUBLE / v_rank + total / 3 + v, 6) AS score FROM b JOIN o USING (video_id)""")
def trake_final_score(t):
    top = search.top_mean(similar(t)).withColumn("v_rank", F.row_number().over(Window.orderBy(F.desc("top_mean"), "video_id")))
    out = align.monotonic_dp(events(t), 3).join(top, "video_id")
    return out.select("video_id", F.col("v_rank").cast("long").alias("v_rank"), F.round(3.0 / F.col("v_rank") + F.col("total") / 3 + F.col("top_mean"), 6).alias("score"))


@query(f"""WITH {FRAMES}, r AS (SELECT f.video_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {dot_sql('f.embedding', 'q.embedding')} DESC, f.global_id) AS rank FROM frames f, embeddings q WHERE q.vec_id IN (3, 42, 99, 7)) SELECT DISTINCT video_id FROM r WHERE rank <= 500""")
def trake_video_pool(t):
    return search.knn_batch(t.features, t.vectors((*EVENTS, 7)), search.pool_size(100)).select("video_id").distinct()


@query(f"{WITH}, {pool(100)} SELECT CAST(rank AS BIGINT) AS rank, video_id, frame_idx || '-' || (frame_idx + 25) || '-' || (frame_idx + 50) AS events FROM pool")
def trake_baseline(t):
    ev = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("frame_idx") + 25 * i)
    return search.knn_exact(t.features, t.vector(7), 100).select(F.col("rank").cast("long").alias("rank"), "video_id", F.array_join(ev.cast("array<string>"), "-").alias("events"))


@query(f"""WITH {FRAMES}, {sim('a', 5)}, {sim('b', 17)}, x AS (SELECT * FROM (SELECT 5 AS cue, *, row_number() OVER (ORDER BY s DESC, global_id) AS rank FROM a) WHERE rank <= 100 UNION ALL SELECT * FROM (SELECT 17, *, row_number() OVER (ORDER BY s DESC, global_id) AS rank FROM b) WHERE rank <= 100)
SELECT video_id, count(DISTINCT cue) / 2.0::DOUBLE AS coverage, round(max(s), 6) AS best FROM x GROUP BY 1""")
def cue_coverage_count(t):
    x = search.knn_batch(t.features, t.vectors((5, 17)), 100)
    return x.groupBy("video_id").agg((F.count_distinct("query_id") / F.lit(2.0)).alias("coverage"), F.round(F.max("s"), 6).alias("best"))


@query(f"""{WITH}, {pool()}, x AS (SELECT *, CASE WHEN global_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS c FROM pool), b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY c DESC, s DESC, global_id) AS r FROM x QUALIFY r <= 4),
v AS (SELECT video_id, max(c) AS vc, max(s) AS vs FROM b GROUP BY 1 ORDER BY vc DESC, vs DESC, video_id LIMIT 5) SELECT video_id, global_id, CAST(r AS BIGINT) AS r, round(vs, 6) AS v_score FROM b JOIN v USING (video_id)""")
def video_aggregate(t):
    rows = search.knn_exact(t.features, t.vector(7), 200).withColumn("coverage", F.when(F.col("global_id") % 3 == 0, 1.0).otherwise(0.5))
    return ranking.aggregate_videos(rows, 4, 5).select("video_id", "global_id", F.col("r").cast("long").alias("r"), r6("v_score"))


_PEAK = "p{i} AS (SELECT s.video_id, arg_max(s.pts_ms, s.s) AS t, arg_max(s.global_id, s.s) AS id, max(s.s) AS v FROM sim s {joins} {where} GROUP BY 1)"
_PEAKS = ", ".join(_PEAK.format(i=i, joins=" ".join(f"JOIN p{j} USING (video_id)" for j in range(1, i)), where="WHERE " + " AND ".join(f"abs(s.pts_ms - p{j}.t) >= 8000" for j in range(1, i)) if i > 1 else "") for i in (1, 2))
_NEARS = ", ".join(f"n{i} AS (SELECT s.video_id, s.global_id AS id, row_number() OVER (PARTITION BY s.video_id ORDER BY s.s DESC, s.global_id) AS k FROM sim s JOIN p{i} USING (video_id) WHERE abs(s.pts_ms - p{i}.t) > 0 AND abs(s.pts_ms - p{i}.t) <= 8000 QUALIFY k <= 2)" for i in (1, 2))


@query(f"""{WITH}, {_PEAKS}, {_NEARS}, picked AS (SELECT video_id, id, 1 AS o FROM p1 UNION ALL SELECT video_id, id, 2 FROM n1 WHERE k = 1 UNION ALL SELECT video_id, id, 3 FROM p2 UNION ALL SELECT video_id, id, 4 FROM n1 WHERE k = 2 UNION ALL SELECT n2.video_id, n2.id, 5 FROM n2 WHERE k = 1),
first AS (SELECT video_id, id, min(o) AS o FROM picked GROUP BY ALL) SELECT s.video_id, s.frame_idx, row_number() OVER (PARTITION BY s.video_id ORDER BY coalesce(o, 6), s.s DESC, s.global_id) AS place FROM sim s LEFT JOIN first ON first.id = s.global_id QUALIFY place <= 40""")
def diverse_hypotheses(t):
    return ranking.diverse_hypotheses(similar(t), 40).select("video_id", "frame_idx", F.col("place").cast("long").alias("place"))
