"""Queries of tokens, BM25, fusion, the search ladder and query analysis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keymoment.functions import text as X
from keymoment.functions.vectors import blend, vector
from keymoment.operators import bm25, bm25_index, fusion, search, temporal
from keymoment.plans.ladder import LADDER, run_ladder
from keymoment.plans.registry import FRAMES, NEIGHBOR, OBJECTS, OCR, TRANSCRIPTS, bm25_sql, clean, dot_sql, pool, query, sim, toks

OCR_QUERY = ["license", "version", "public", "the", "que"]
ASR_QUERY = ["the", "der", "than", "reer", "ción"]
r6 = lambda c: F.round(c, 6).alias(c)
CONV = f"""{TRANSCRIPTS}, spoken AS (SELECT conv_id * 100 + turn AS seg_id, * FROM transcripts)"""
JOINED = "array_to_string(list_sort({}), ' ')"


def spoken(t):
    return t.segments


def _hits(t, index: str, doc: str, tokens: list[str], k: int | None):
    s = bm25_index.score(t.spark, t.index(index), bm25_index.asked(t.spark, {"q": tokens})).select(F.col("doc").alias(doc), "score")
    return bm25.top_hits(s, doc, k) if k else s


def ocr_hits(t, k: int | None = None, tokens: list[str] = OCR_QUERY):
    return _hits(t, "ocr", "doc_id", tokens, k)


def asr_hits(t, k: int | None = None):
    return _hits(t, "asr", "seg_id", ASR_QUERY, k)


@query(f"SELECT doc_id, {JOINED.format(toks('text'))} AS tokens FROM documents")
def tokenize_dual(t):
    return t.read("documents").select("doc_id", F.array_join(F.sort_array(X.tokens_dual(F.col("text"))), " ").alias("tokens"))


@query("SELECT doc_id, replace(strip_accents(lower(coalesce(text, ''))), 'đ', 'd') AS plain FROM documents")
def strip_accents(t):
    return t.read("documents").select("doc_id", X.strip_accents(F.lower(F.coalesce("text", F.lit("")))).alias("plain"))


@query(f"SELECT doc_id, array_to_string({clean('text')}, ' ') AS tokens FROM documents")
def tokenize_clean(t):
    return t.read("documents").select("doc_id", F.array_join(X.tokens_clean(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, round(least(1.0::DOUBLE, len(list_intersect(['the', 'of', 'license', 'version', 'que'], {clean('text')})) / 5.0::DOUBLE), 6) AS overlap FROM documents")
def token_overlap(t):
    q = F.array(*[F.lit(w) for w in ("the", "of", "license", "version", "que")])
    return t.read("documents").select("doc_id", F.round(F.least(F.lit(1.0), F.size(F.array_intersect(q, X.tokens_clean(F.col("text")))) / F.greatest(F.lit(1), F.size(q))), 6).alias("overlap"))


@query(f"WITH {bm25_sql('documents', 'doc_id', toks('text'), OCR_QUERY)} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 100")
def bm25_ocr(t):
    return ocr_hits(t, 100).select("doc_id", r6("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CONV}, {bm25_sql('spoken', 'seg_id', toks('transcript'), ASR_QUERY)} SELECT seg_id, (start_frame + end_frame) // 2 AS frame_idx, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, seg_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 100) JOIN spoken USING (seg_id)")
def bm25_asr(t):
    return asr_hits(t, 100).join(spoken(t), "seg_id").select("seg_id", F.expr("(start_frame + end_frame) div 2").alias("frame_idx"), r6("score"))


@query(f"WITH {bm25_sql('documents', 'doc_id', toks('text'), OCR_QUERY)}, v AS (SELECT token, df, raw FROM raw) SELECT count(*) AS tokens, sum(df) AS postings, round(avg(raw), 6) AS mean, round((SELECT avg(len(toks)) FROM tk), 6) AS avgdl FROM v")
def bm25_index_at_rest(t):
    """What the stored index holds."""
    path = t.index("ocr")
    v, c = t.spark.read.parquet(f"{path}/vocabulary"), t.spark.read.parquet(f"{path}/corpus")
    n = t.spark.read.parquet(f"{path}/postings").agg(F.count("*").alias("postings"))
    return v.agg(F.count("*").alias("tokens")).join(n).join(c).select("tokens", "postings", r6("mean"), r6("avgdl"))


@query(f"WITH {bm25_sql('part', 'p_partkey', toks('p_name'), ['red', 'blue', 'green', 'part'])} SELECT p_partkey, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, p_partkey) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 50")
def bm25_meta(t):
    s = bm25.bm25(t.read("part"), "p_partkey", X.tokens_dual(F.col("p_name")), ["red", "blue", "green", "part"])
    return bm25.top_hits(s, "p_partkey", 50).select("p_partkey", r6("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CONV}, {bm25_sql('spoken', 'seg_id', clean('transcript'), ASR_QUERY, 'video_id')} SELECT video_id, seg_id, round(CASE WHEN max(score) OVER (PARTITION BY video_id) > 0 THEN score / max(score) OVER (PARTITION BY video_id) ELSE 0 END, 6) AS norm FROM scored")
def bm25_intra_video(t):
    s = bm25.bm25(spoken(t), "seg_id", X.tokens_clean(F.col("transcript")), ASR_QUERY, ["video_id"])
    top = F.max("score").over(Window.partitionBy("video_id"))
    return s.select("video_id", "seg_id", F.round(F.when(top > 0, F.col("score") / top).otherwise(0.0), 6).alias("norm"))


_TWO = [["license"], ["version", "public"], ["license", "version", "public"]]


@query("WITH " + ", ".join(f"s{i} AS (WITH {bm25_sql('documents', 'doc_id', toks('text'), q)} SELECT doc_id, score FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {20 if i == 2 else 10})" for i, q in enumerate(_TWO))
       + " SELECT doc_id, round(max(score), 6) AS best FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY doc_id ORDER BY max(score) DESC, doc_id LIMIT 25")
def multi_keyword_max(t):
    every = None
    for i, q in enumerate(_TWO):
        hits = ocr_hits(t, 20 if i == 2 else 10, q).select("doc_id", "score")
        every = hits if every is None else every.unionByName(hits)
    return every.groupBy("doc_id").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "doc_id").limit(25).select("doc_id", r6("best"))


_LEX = f"""o AS (WITH {bm25_sql('documents', 'doc_id', toks('text'), OCR_QUERY)} SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 200),
om AS (SELECT global_id, max(score / (SELECT max(score) FROM o)) AS ocr_frame FROM o JOIN ocr USING (doc_id) GROUP BY 1), ov AS (SELECT video_id, max(ocr_frame) AS ocr_video FROM om JOIN frames USING (global_id) GROUP BY 1),
sg AS (WITH {bm25_sql('spoken', 'seg_id', toks('transcript'), ASR_QUERY)} SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, seg_id LIMIT 200),
am AS (SELECT f.global_id, max(g.score / (SELECT max(score) FROM sg)) AS asr_frame FROM sg g JOIN spoken USING (seg_id) JOIN frames f ON f.video_id = spoken.video_id AND f.frame_idx = (start_frame + end_frame) // 2 GROUP BY 1),
av AS (SELECT video_id, max(g.score / (SELECT max(score) FROM sg)) AS asr_video FROM sg g JOIN spoken USING (seg_id) GROUP BY 1)"""


def _bonus(x: str) -> str:
    v = f"greatest(coalesce({x}_frame, 0.0::DOUBLE), 0.8::DOUBLE * coalesce({x}_video, 0.0::DOUBLE))"
    return f"s * CASE WHEN {v} > 0.1 THEN 0.15::DOUBLE * {v} ELSE 0 END"


_END = "SELECT global_id, video_id, row_number() OVER (ORDER BY round(final, 9) DESC, global_id) AS rank, round(final, 6) AS final FROM t QUALIFY rank <= 100"
_DUAL = f"""m AS (SELECT list_transform(list_zip(a.embedding, b.embedding), lambda z: 0.7::DOUBLE * z[1] + 0.3::DOUBLE * z[2]) AS v FROM (SELECT embedding FROM embeddings WHERE vec_id = 7) a, (SELECT embedding FROM embeddings WHERE vec_id = 11) b),
sim AS (SELECT f.*, {dot_sql('f.embedding', f"list_transform(m.v, lambda x: x / sqrt({dot_sql('m.v', 'm.v')}))")} AS s FROM frames f, m)"""
_LADDER_SQL = {
    "tnca_a0": f"WITH {FRAMES}, {sim()}, t AS (SELECT *, s AS final FROM sim) {_END}",
    "tnca_a1": f"WITH {FRAMES}, {_DUAL}, t AS (SELECT *, s AS final FROM sim) {_END}",
    "tnca_a2": f"WITH {FRAMES}, {_DUAL}, {pool()}, {NEIGHBOR}, t AS (SELECT global_id, video_id, s + 0.075::DOUBLE * neighbor AS final FROM near) {_END}",
    "tnca_a3": f"WITH {FRAMES}, {OCR}, {CONV}, {_DUAL}, {pool()}, {NEIGHBOR}, {_LEX}, t AS (SELECT near.global_id, near.video_id, s + 0.075::DOUBLE * neighbor + {_bonus('ocr')} + {_bonus('asr')} AS final FROM near LEFT JOIN om USING (global_id) LEFT JOIN ov USING (video_id) LEFT JOIN am USING (global_id) LEFT JOIN av USING (video_id)) {_END}",
}


def _support(t):
    f = t.features.select("global_id", "video_id", "frame_idx")
    few = lambda hits: t.spark.createDataFrame(hits.toArrow())  # noqa: E731, 200 rows: scored once, whatever reads them
    share = lambda hits: few(hits).withColumn("norm", F.col("score") / F.greatest(F.max("score").over(Window.partitionBy()), F.lit(1e-6)))  # noqa: E731, of 200 rows
    o = share(ocr_hits(t, 200)).join(t.ocr.select("doc_id", "global_id"), "doc_id").join(f, "global_id")
    a = share(asr_hits(t, 200)).join(spoken(t).select("seg_id", "video_id", F.expr("(start_frame + end_frame) div 2").alias("frame_idx")), "seg_id")
    a = a.join(f, ["video_id", "frame_idx"], "left")
    return {"ocr": fusion.lexical_support(o, "ocr"), "asr": (fusion.lexical_support(a.where("global_id IS NOT NULL"), "asr")[0], fusion.lexical_support(a, "asr")[1])}


def _ladder(name):
    def run(t):
        config = LADDER[name]
        v = t.vector(7) if not config.dual else list(t.spark.range(1).select(blend(vector(t.vector(7)), vector(t.vector(11)), 0.7, 0.3).alias("v")).first()["v"])
        out = run_ladder(t.features, v, config, _support(t) if config.lexical else {}, 100, transition=False)
        return out.select("global_id", "video_id", F.col("rank").cast("long").alias("rank"), r6("final"))

    return run


for _name, _sql in _LADDER_SQL.items():
    query(_sql, _name)(_ladder(_name.removeprefix("tnca_")))

_LISTS = f"""{FRAMES}, {OCR}, {CONV}, {sim()}, v AS (SELECT global_id, row_number() OVER (ORDER BY s DESC, global_id) AS rank FROM sim QUALIFY rank <= 200),
o AS (WITH {bm25_sql('documents', 'doc_id', toks('text'), OCR_QUERY)} SELECT global_id, row_number() OVER (ORDER BY m DESC, global_id) AS rank FROM (SELECT global_id, max(score) AS m FROM scored JOIN ocr USING (doc_id) WHERE score > 0 GROUP BY 1) QUALIFY rank <= 100),
a AS (WITH {bm25_sql('spoken', 'seg_id', toks('transcript'), ASR_QUERY)} SELECT global_id, row_number() OVER (ORDER BY m DESC, global_id) AS rank FROM (SELECT f.global_id, max(score) AS m FROM scored JOIN spoken USING (seg_id) JOIN frames f ON f.video_id = spoken.video_id AND f.frame_idx = (start_frame + end_frame) // 2 WHERE score > 0 GROUP BY 1) QUALIFY rank <= 100)"""


def lists(t):
    rank = lambda df, s: df.orderBy(F.desc(s), "global_id").limit(100).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(s), "global_id")))
    o = ocr_hits(t).where("score > 0").join(t.ocr.select("doc_id", "global_id"), "doc_id").groupBy("global_id").agg(F.max("score").alias("m"))
    a = asr_hits(t).where("score > 0").join(spoken(t).select("seg_id", "video_id", F.expr("(start_frame + end_frame) div 2").alias("frame_idx")), "seg_id")
    a = a.join(t.features.select("global_id", "video_id", "frame_idx"), ["video_id", "frame_idx"]).groupBy("global_id").agg(F.max("score").alias("m"))
    return {"visual": (search.knn_exact(t.features, t.vector(7), 200), 0.70), "ocr": (rank(o, "m"), 0.18), "asr": (rank(a, "m"), 0.12)}


@query(f"WITH {_LISTS}, u AS (SELECT global_id, 0.70::DOUBLE / (60 + rank) AS p FROM v UNION ALL SELECT global_id, 0.18::DOUBLE / (60 + rank) FROM o UNION ALL SELECT global_id, 0.12::DOUBLE / (60 + rank) FROM a) SELECT global_id, round(sum(p), 6) AS fused, count(*) AS lists FROM u GROUP BY 1")
def wrrf(t):
    return fusion.wrrf(lists(t), ["global_id"]).select("global_id", r6("fused"), "lists")


@query(f"WITH {_LISTS} SELECT global_id, v.rank AS visual_rank, o.rank AS ocr_rank, a.rank AS asr_rank FROM v FULL OUTER JOIN o USING (global_id) FULL OUTER JOIN a USING (global_id)")
def merge_lists_full_outer(t):
    every = None
    for name, (df, _) in lists(t).items():
        part = df.select("global_id", F.struct(F.lit(name).alias("n"), F.col("rank").cast("long").alias("rank")).alias("x"))
        every = part if every is None else every.unionByName(part)
    pick = lambda n: F.max(F.when(F.col("x.n") == n, F.col("x.rank"))).alias(f"{n}_rank")
    return every.groupBy("global_id").agg(pick("visual"), pick("ocr"), pick("asr"))


@query(f"WITH {_LISTS}, u AS (SELECT global_id, 0 AS o, 0.35::DOUBLE + 0.18::DOUBLE / (60 + rank) AS p FROM o UNION ALL SELECT global_id, 1, 0.30::DOUBLE + 0.12::DOUBLE / (60 + rank) FROM a UNION ALL SELECT v.global_id, 2, s FROM v JOIN sim USING (global_id)) SELECT global_id, round(arg_min(p, o), 6) AS boosted FROM u GROUP BY 1")
def additive_keyword_boost(t):
    x = lists(t)
    u = x["ocr"][0].select("global_id", F.lit(0).alias("o"), (0.35 + 0.18 / (60 + F.col("rank"))).alias("p"))
    u = u.unionByName(x["asr"][0].select("global_id", F.lit(1).alias("o"), (0.30 + 0.12 / (60 + F.col("rank"))).alias("p")))
    u = u.unionByName(x["visual"][0].select("global_id", F.lit(2).alias("o"), F.col("s").alias("p")))
    return u.groupBy("global_id").agg(F.round(F.min_by("p", "o"), 6).alias("boosted"))


#: Cues of the reranked query, by vector.
CUES = (5, 17)
_GAUSS = "(SELECT a.global_id, sum(exp(0 - ((a.pts_ms - b.pts_ms) / 1000.0::DOUBLE) * ((a.pts_ms - b.pts_ms) / 1000.0::DOUBLE) / 32) * b.s) / sum(exp(0 - ((a.pts_ms - b.pts_ms) / 1000.0::DOUBLE) * ((a.pts_ms - b.pts_ms) / 1000.0::DOUBLE) / 32)) AS smooth FROM sim a JOIN sim b USING (video_id) GROUP BY 1)"
_INTRA = f"""{FRAMES}, {sim()}, {sim('c1', CUES[0])}, {sim('c2', CUES[1])}, {OCR}, {OBJECTS}, gs AS {_GAUSS},
cu AS (SELECT c1.global_id, (max(c1.s) OVER w + max(c2.s) OVER w) / 2 AS cue FROM c1 JOIN c2 USING (global_id) WINDOW w AS (PARTITION BY c1.video_id ORDER BY c1.pts_ms RANGE BETWEEN 6000 PRECEDING AND 6000 FOLLOWING)),
oc AS (SELECT global_id, max(least(1.0::DOUBLE, len(list_intersect(['the', 'of', 'license', 'version', 'que'], {clean('ocr_text')})) / 5.0::DOUBLE)) AS ocr FROM ocr GROUP BY 1),
ob AS (SELECT global_id, least(1.0::DOUBLE, count(*) FILTER (WHERE score > 0.7) / 10.0::DOUBLE) AS obj FROM objects GROUP BY 1),
fin AS (SELECT sim.*, smooth, cue, 0.55::DOUBLE * s + 0.25::DOUBLE * smooth + 0.20::DOUBLE * cue + 0.35::DOUBLE * coalesce(ocr, 0) + CASE WHEN max(coalesce(obj, 0)) OVER (PARTITION BY video_id) > 0 THEN 0.10::DOUBLE * coalesce(obj, 0) ELSE 0 END AS final, 0.65::DOUBLE * s + 0.35::DOUBLE * smooth AS plain
 FROM sim JOIN gs USING (global_id) JOIN cu USING (global_id) LEFT JOIN oc USING (global_id) LEFT JOIN ob USING (global_id))"""


def _intra(t):
    """Frames with final: similarity, neighbours, cues, and what text in the picture and objects add."""
    frames = search.with_similarities(t.features, {"s": t.vector(7)} | {f"c{i}": t.vector(v) for i, v in enumerate(CUES)})
    words = F.array(*[F.lit(w) for w in ("the", "of", "license", "version", "que")])
    overlap = F.least(F.lit(1.0), F.size(F.array_intersect(words, X.tokens_clean(F.col("ocr_text")))) / 5.0)
    ocr = t.ocr.groupBy("global_id").agg(F.max(overlap).alias("ocr"))
    objects = t.objects.groupBy("global_id").agg(F.least(F.lit(1.0), F.count_if(F.col("score") > 0.7) / 10.0).alias("obj"))
    rows = frames.join(temporal.gaussian_smooth(frames, 4.0).select("global_id", "smooth"), "global_id")
    rows = temporal.window_coverage(rows, ["c0", "c1"]).join(ocr, "global_id", "left").join(objects, "global_id", "left")
    return fusion.intra_video(rows, {"ocr": 0.35}, "obj")


@query(f"WITH {_INTRA} SELECT global_id, round(final, 5) AS final, round(plain, 5) AS without_cues FROM fin")
def intra_video_final(t):
    plain = fusion.intra_video(_intra(t).drop("coverage", "final"), {}).select("global_id", F.round("final", 5).alias("without_cues"))
    return _intra(t).select("global_id", F.round("final", 5).alias("final")).join(plain, "global_id")


@query(f"WITH {_INTRA}, b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY s DESC, global_id) AS rank FROM sim) WHERE rank <= 100), top AS (SELECT video_id FROM b GROUP BY 1 ORDER BY min(rank) LIMIT 3) SELECT f.global_id, round(CASE WHEN b.global_id IS NULL THEN f.final WHEN top.video_id IS NULL THEN b.s ELSE b.s + 0.4::DOUBLE * (f.final - f.s) END, 5) AS reranked FROM fin f LEFT JOIN b USING (global_id) LEFT JOIN top ON top.video_id = f.video_id WHERE b.global_id IS NOT NULL OR top.video_id IS NOT NULL")
def rerank_delta(t):
    """With 3 candidate videos, as the standard tables have ten; 25 and 50 are those of single and question search."""
    b = search.knn_exact(t.features, t.vector(7), 100)
    videos = b.groupBy("video_id").agg(F.min("rank").alias("first")).orderBy("first").limit(3).select("video_id")
    scored = _intra(t).join(F.broadcast(videos), "video_id").select("global_id", "final", F.col("s").alias("raw"))
    return fusion.rerank(b, scored).select("global_id", F.round("reranked", 5).alias("reranked"))


@query(f"WITH {FRAMES}, {sim()}, {pool(100)}, x AS (SELECT global_id, rank, CASE WHEN rank <= 10 THEN s + 0.35::DOUBLE * ((global_id % 10) / 10.0::DOUBLE - 0.5) ELSE s END AS v FROM pool) SELECT global_id, CAST(row_number() OVER (ORDER BY rank > 10, CASE WHEN rank <= 10 THEN -v END, rank) AS BIGINT) AS place, round(v, 6) AS blended FROM x")
def vlm_score_blend(t):
    v = F.when(F.col("rank") <= 10, F.col("s") + 0.35 * ((F.col("global_id") % 10) / 10.0 - 0.5)).otherwise(F.col("s"))
    x = search.knn_exact(t.features, t.vector(7), 100).withColumn("v", v)
    return x.select("global_id", F.row_number().over(Window.orderBy(F.col("rank") > 10, F.when(F.col("rank") <= 10, -F.col("v")), "rank")).cast("long").alias("place"), F.round("v", 6).alias("blended"))


@query("SELECT query_id, rank, coalesce(answer, first_value(answer IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS answer FROM (SELECT 'q' || user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, CASE WHEN event_id % 4 = 1 THEN event_type END AS answer FROM events)")
def answer_propagation(t):
    e = t.read("events").select(F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("rank"), F.when(F.col("event_id") % 4 == 1, F.col("event_type")).alias("answer"))
    return fusion.propagate_answer(e)


@query(f"WITH {_LISTS}, g AS (WITH {bm25_sql('spoken', 'seg_id', toks('transcript'), ASR_QUERY)} SELECT seg_id AS id, 0.90::DOUBLE + 0.01::DOUBLE * score AS x, 0 AS o FROM scored WHERE score > 3.5) SELECT o, id, round(x, 6) AS x FROM g UNION ALL SELECT 1, global_id, round(s, 6) FROM v JOIN sim USING (global_id) WHERE v.rank <= 50")
def speech_grounding(t):
    g = asr_hits(t).where("score > 3.5").select(F.lit(0).alias("o"), F.col("seg_id").alias("id"), F.round(0.90 + 0.01 * F.col("score"), 6).alias("x"))
    return g.unionByName(search.knn_exact(t.features, t.vector(7), 50).select(F.lit(1).alias("o"), F.col("global_id").alias("id"), F.round("s", 6).alias("x")))


_TEXTS = [
    "Có bao nhiêu người, rồi chạy?", "E1: mở cửa phòng ngủ\nE2: chạy ra ngoài sân", "Người đàn ông nói về bảng hiệu \"COVID-19\" của Steven Spielberg; sau đó rời khỏi phòng", "A red car. A blue bus stops, then open the door",
    "con số hiển thị trên cân là gì", "nothing special here", "chuỗi hành động: đầu tiên cô gái rót nước, tiếp theo cầm ly nước lên, cuối cùng uống hết ly nước", "một con chó và một con mèo, ở trong nhà", "MC nói với khán giả", "phóng viên  kể về logo trên áo",
    "Event 1: first thing here\nEvent 2: second thing", "khoảnh khắc đầu tiên: biển số xe\nBước 2: xe chạy", "1) cut the bread\n2. hold it", "sự kiện 1: bật đèn; tắt đèn",
]
_VALUES = ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(_TEXTS))


def _texts(t):
    return t.spark.createDataFrame(list(enumerate(_TEXTS)), "id int, text string").unionByName(t.read("benchmark").select((F.col("item_id") + 100).cast("int").alias("id"), "text"))


def _q(expr: str, more: str = "") -> str:
    return f"WITH q AS (SELECT * FROM (VALUES {_VALUES}) v(id, text) UNION ALL SELECT CAST(item_id + 100 AS INTEGER), text FROM benchmark){more} SELECT id, {expr} FROM q"


def _has(words, text: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _list(x: str, more_than: int = 0) -> str:
    """Parts without blanks around, of more characters than so many."""
    return f"list_filter(list_transform({x}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > {more_than})"


@query(_q(f"CASE WHEN {_has(X.QUESTION_WORDS)} THEN 'qa' WHEN {_has(X.SEQUENCE_MARKS)} THEN 'trake' ELSE 'kis' END AS task"))
def task_detect(t):
    return _texts(t).select("id", X.task_of(F.col("text")).alias("task"))


@query(_q(f"regexp_matches(lower(text), '{X.COUNT}') AS is_count"))
def is_count_query(t):
    return _texts(t).select("id", X.is_count(F.col("text")).alias("is_count"))


@query(_q(f"{_has(X.TRANSITION_WORDS)} AS transition"))
def transition_flag(t):
    return _texts(t).select("id", X.has_transition(F.col("text")).alias("transition"))


@query(_q(f"len(list_intersect({clean('text')}, [{', '.join(repr(v) for v in X.ACTION_VERBS)}])) > 0 AS acts"))
def action_verb_flag(t):
    return _texts(t).select("id", X.has_action(F.col("text")).alias("acts"))


@query(_q(f"array_to_string(list_slice({_list("regexp_split_to_array(text, '[,;.]')", 3)}, 1, 4), '|') AS cues"))
def cue_split(t):
    return _texts(t).select("id", F.array_join(X.cues(F.col("text")), "|").alias("cues"))


_LOUD = X.WRITTEN.replace("'", "''")
_SAID5 = "list_slice(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: length(w) > 3), 1, 5)"
_LINES5 = f"list_filter({_list('string_split(text, chr(10))')}, lambda x: regexp_matches(x, '^[eE][0-9]+[:\\s\\-.]') OR contains(lower(x), '{X.EVENT_WORD}'))"
_PARTS5 = _list(f"regexp_split_to_array(text, '{X.EVENT_BREAKS}')", 10)


@query(_q(f"""round(v / (v + o + a), 6) AS visual, round(o / (v + o + a), 6) AS ocr, round(a / (v + o + a), 6) AS asr, array_to_string(CASE WHEN has_ocr THEN {_SAID5} ELSE [] END, ' ') AS ocr_keywords, array_to_string(CASE WHEN has_asr THEN {_SAID5} ELSE [] END, ' ') AS asr_keywords,
array_to_string(CASE WHEN len({_LINES5}) > 0 THEN {_LINES5} WHEN trake AND len({_PARTS5}) > 0 THEN {_PARTS5} ELSE [text] END, '|') AS events""").replace(" FROM q", f""" FROM (SELECT *, CASE WHEN has_ocr OR has_asr THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS v, CASE WHEN has_ocr THEN 0.4::DOUBLE ELSE 0.05::DOUBLE END AS o, CASE WHEN has_asr THEN 0.4::DOUBLE ELSE 0.05::DOUBLE END AS a FROM
(SELECT *, regexp_matches(lower(text), '{_LOUD}') AS has_ocr, regexp_matches(lower(text), '{X.SPOKEN}') AS has_asr, {_has(X.SEQUENCE_MARKS)} AND NOT {_has(X.QUESTION_WORDS)} AS trake FROM q))"""))  # fmt: skip
def refine_fallback(t):
    x = _texts(t).select("id", X.refine(F.col("text"), X.task_of(F.col("text"))).alias("x"))
    return x.select("id", *[F.round(f"x.{n}", 6).alias(n) for n in ("visual", "ocr", "asr")], *[F.array_join(f"x.{n}", " ").alias(n) for n in ("ocr_keywords", "asr_keywords")], F.array_join("x.events", "|").alias("events"))


_EDGED = "[^\\p{L}\\p{N}_]"
_CUT = f"string_split(regexp_replace(chr(10) || text, '{X.EVENT_LINE}', chr(1), 'g'), chr(1))"
_EV = _list(f"({_CUT})[2:]")
_GO = _list(f"regexp_split_to_array(regexp_replace(text, '({_EDGED})(và|tiếp tục|cuối cùng)({_EDGED})', '\\1,\\3', 'g'), '[,;]')")


@query(_q(f"array_to_string(CASE WHEN len({_EV}) >= 2 THEN {_EV} WHEN len({_GO}) >= 2 THEN {_GO} ELSE [text, text] END, '|') AS events"))
def event_split(t):
    return _texts(t).select("id", F.array_join(X.split_events(F.col("text")), "|").alias("events"))


_AT = _list("regexp_split_to_array(text, 'E[0-9]+:|E[0-9]+\\s+|;\\s*|sau đó|tiếp theo|kế đến')", 10)


@query(_q(f"array_to_string(CASE WHEN len({_AT}) >= 2 THEN {_AT} ELSE [text, text, text] END, '|') AS events"))
def event_split_at_words(t):
    return _texts(t).select("id", F.array_join(X.split_events_at_words(F.col("text")), "|").alias("events"))


_MARK = "(?i)^((sự kiện|event|bước|e)\\s*[0-9]+[:.-]|[0-9]+[.)])\\s*"
_NUMBERED = _list(f"list_transform(list_filter({_list('string_split(text, chr(10))')}, lambda x: regexp_matches(x, '{_MARK}')), lambda x: regexp_replace(x, '{_MARK}', ''))")
_BROKEN = _list("regexp_split_to_array(text, '[\n;]')", 8)


@query(_q(f"array_to_string(CASE WHEN len({_NUMBERED}) > 0 THEN {_NUMBERED} WHEN len({_BROKEN}) >= 2 THEN {_BROKEN} ELSE ['Sự kiện 1', 'Sự kiện 2', 'Sự kiện 3'] END, '|') AS events"))
def event_split_of_lines(t):
    return _texts(t).select("id", F.array_join(X.split_events_of_lines(F.col("text")), "|").alias("events"))


_GATE_WORDS = lambda words: f"(^|{_EDGED})({'|'.join(words)})($|{_EDGED})"
_QUOTES = X.QUOTED.replace("'", "''")
# Words with accents aren't names to the pattern; RE2 bounds words in ASCII only, so they are taken out first.
_NAMED = "list_filter(regexp_extract_all(regexp_replace(text, '[\\p{L}\\p{N}_]*[À-ɏḀ-ỿ][\\p{L}\\p{N}_]*', 'x', 'g'), '\\b[A-Z][a-zA-Z0-9\\-_]{2,}\\b(?:\\s+[A-Z][a-zA-Z0-9\\-_]+)*'), lambda x: lower(x) NOT IN (" + ", ".join(f"'{w}'" for w in X.NO_NAMES) + "))"
_SPEAKS = f"(^|{_EDGED})({'|'.join(X.SPEAKERS)})\\s+({'|'.join(X.SPEAKER_VERBS)})($|{_EDGED})"
_HEARD = "list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND lower(w) NOT IN (" + ", ".join(f"'{w}'" for w in X.NO_SPEECH) + "))"


@query(_q("CASE WHEN o THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS ocr_weight, CASE WHEN a THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END AS asr_weight, NOT o AND NOT a AS pure_visual, quoted, CASE WHEN a THEN heard ELSE '' END AS asr_keywords").replace(" FROM q", f""" FROM (SELECT *, array_to_string(regexp_extract_all(text, '{_QUOTES}', 1), '|') AS quoted,
(SELECT string_agg(w, ' ' ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(list_slice({_HEARD}, 1, 8)) AS w, generate_subscripts(list_slice({_HEARD}, 1, 8), 1) AS i) GROUP BY w)) AS heard,
regexp_matches(text, '{_QUOTES}') OR len({_NAMED}) > 0 OR regexp_matches(lower(text), '{_GATE_WORDS(X.OCR_WORDS)}') AS o, regexp_matches(lower(text), '{_GATE_WORDS(X.ASR_WORDS)}') OR regexp_matches(lower(text), '{_SPEAKS}') AS a FROM q)"""))  # fmt: skip
def modality_gate(t):
    x = _texts(t).select("id", "text", X.gate(F.col("text")).alias("x"))
    quoted = F.regexp_extract_all(F.col("text"), F.lit(X.QUOTED), F.lit(1))
    return x.select("id", F.col("x.ocr").alias("ocr_weight"), F.col("x.asr").alias("asr_weight"), "x.pure_visual", F.array_join(quoted, "|").alias("quoted"), F.array_join("x.asr_keywords", " ").alias("asr_keywords"))


@query("WITH w AS (SELECT o_orderkey, (o_orderkey % 3)::DOUBLE AS a, (o_orderkey % 2)::DOUBLE AS b, 0.0::DOUBLE AS c FROM orders) SELECT o_orderkey, round(CASE WHEN a + b + c <= 1e-6 THEN 0.8::DOUBLE ELSE a / (a + b + c) END, 6) AS wa, round(CASE WHEN a + b + c <= 1e-6 THEN 0.1::DOUBLE ELSE b / (a + b + c) END, 6) AS wb FROM w")
def weight_normalize(t):
    a, b = (F.col("o_orderkey") % 3).cast("double"), (F.col("o_orderkey") % 2).cast("double")
    part = lambda x, d: F.round(F.when(a + b <= 1e-6, d).otherwise(F.try_divide(x, a + b)), 6)
    return t.read("orders").select("o_orderkey", part(a, 0.8).alias("wa"), part(b, 0.1).alias("wb"))


@query("SELECT event_id, event_type AS kind, CAST(event_id % 7 AS INTEGER) AS n FROM events")
def json_salvage(t):
    said = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(F.col("event_type").alias("kind"), (F.col("event_id") % 7).cast("int").alias("n"))), F.lit("\n``` done"))
    return t.read("events").select("event_id", X.salvage_json(said, "kind string, n int").alias("x")).select("event_id", "x.kind", "x.n")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN event_type || '|' || event_type || '|' || event_type ELSE event_type || '|b|c' END AS prompts, CASE WHEN event_id % 3 > 0 THEN event_id % 2 = 0 END AS is_qa FROM events")
def json_salvage_broken(t):
    """Analyses that no JSON parser reads: cut off behind the prompts."""
    k = F.col("event_id") % 3
    prompts = F.when(k == 0, "").when(k == 1, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('", "b", "c", "d"')))
    said = F.concat(F.lit('{"visual_prompts": ['), prompts, F.lit('], "is_qa": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(', "ocr_keywords": ['))
    x = t.read("events").select("event_id", X.salvage_prompts(said).alias("x"))
    return x.select("event_id", F.array_join("x.visual_prompts", "|").alias("prompts"), "x.is_qa")
