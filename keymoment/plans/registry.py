"""Registered queries: a function of the logical tables, and its SQL over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keymoment.sources.standard import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[key] = sql
        return f

    return add


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


FRAMES = """frames AS (SELECT vec_id AS global_id, 'V' || lpad(CAST(label AS VARCHAR), 3, '0') AS video_id,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS keyframe_index, vec_id * 2000 AS pts_ms, vec_id * 2.0::DOUBLE AS pts_time, vec_id * 50 AS frame_idx, embedding FROM embeddings)"""


def sim(name: str = "sim", vec: int = 7) -> str:
    return f"{name} AS (SELECT f.*, {dot_sql('f.embedding', 'q.embedding')} AS s FROM frames f, (SELECT embedding FROM embeddings WHERE vec_id = {vec}) q)"


def pool(k: int = 200) -> str:
    return f"pool AS (SELECT *, row_number() OVER (ORDER BY s DESC, global_id) AS rank FROM sim QUALIFY rank <= {k})"


TRANSCRIPTS = """transcripts AS (SELECT conv_id, turn, 'V' || lpad(CAST(conv_id % 10 AS VARCHAR), 3, '0') AS video_id, conv_id * 4000 + turn * 1000 AS start_ms, conv_id * 4000 + turn * 1000 + 3000 AS end_ms,
  (conv_id * 4000 + turn * 1000) * 25 // 1000 AS start_frame, (conv_id * 4000 + turn * 1000 + 3000) * 25 // 1000 AS end_frame, text AS transcript FROM conversations)"""
OCR = "ocr AS (SELECT doc_id, doc_id % (SELECT count(*) FROM embeddings) AS global_id, text AS ocr_text FROM documents)"
OBJECTS = "objects AS (SELECT event_id, event_id % (SELECT count(*) FROM embeddings) AS global_id, event_type AS entity, least(1.0::DOUBLE, CAST(value AS DOUBLE) / 50.0::DOUBLE) AS score FROM events)"
NEIGHBOR = """near AS (SELECT *, coalesce(greatest(max(s) OVER (PARTITION BY video_id ORDER BY pts_ms RANGE BETWEEN 30000 PRECEDING AND 1 PRECEDING),
  max(s) OVER (PARTITION BY video_id ORDER BY pts_ms RANGE BETWEEN 1 FOLLOWING AND 30000 FOLLOWING)), s) AS neighbor FROM pool)"""
TRUTH = f"""{FRAMES}, truth AS (SELECT 'q-' || video_id AS query_id, video_id AS true_video, max(CASE WHEN keyframe_index = 3 THEN frame_idx END) AS start_frame,
  max(CASE WHEN keyframe_index = 5 THEN frame_idx END) AS end_frame, max(CASE WHEN keyframe_index = 2 THEN frame_idx END) AS e1, max(CASE WHEN keyframe_index = 4 THEN frame_idx END) AS e2,
  max(CASE WHEN keyframe_index = 6 THEN frame_idx END) AS e3, min(global_id) AS first_id FROM frames WHERE keyframe_index <= 6 GROUP BY video_id)"""
PREDICTED = f"""{TRUTH}, predicted AS (SELECT t.query_id, f.global_id, f.video_id, f.pts_ms, f.frame_idx, {dot_sql('f.embedding', 'q.embedding')} AS s,
  row_number() OVER (PARTITION BY t.query_id ORDER BY {dot_sql('f.embedding', 'q.embedding')} DESC, f.global_id) AS rank FROM truth t JOIN embeddings q ON q.vec_id = t.first_id CROSS JOIN frames f QUALIFY rank <= 100)"""


def toks(text: str) -> str:
    """The set of tokens of tokens_dual."""
    low = f"lower(coalesce({text}, ''))"
    whole = f"regexp_extract_all({low}, '[a-z0-9]+-[a-z0-9]+')"
    words = f"list_filter(regexp_split_to_array(regexp_replace({low}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 OR regexp_full_match(w, '[0-9]') OR w IN ('a', 'y', 'ở', 'ổ', 'ố', 'á', 'à'))"
    every = f"list_concat(list_concat({whole}, list_transform({whole}, lambda w: replace(w, '-', ''))), {words})"
    return f"list_distinct(list_concat({every}, list_filter(list_transform({every}, lambda w: replace(strip_accents(w), 'đ', 'd')), lambda w: length(w) > 1)))"


def clean(text: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 0)"


def bm25_sql(source: str, doc: str, tokens: str, query: list[str], group: str = "") -> str:
    """CTEs of a BM25 over `source`, ending in scored(group, doc, score)."""
    times: dict[str, int] = {}
    for q in query:
        times[q] = times.get(q, 0) + 1
    asked = ", ".join(f"('{q}', {c})" for q, c in times.items())
    g, on = (f"{group}, ", f"{group}") if group else ("", "")
    using = f"USING ({on})" if group else "ON true"
    return f"""tk AS (SELECT {g}{doc}, {tokens} AS toks FROM {source}), st AS (SELECT {g}count(*) AS n, avg(len(toks)) AS avgdl FROM tk {'GROUP BY ' + on if group else ''}),
po AS (SELECT {g}{doc}, dl, token, count(*) AS tf FROM (SELECT {g}{doc}, len(toks) AS dl, unnest(toks) AS token FROM tk) GROUP BY ALL),
df AS (SELECT {g}token, count(*) AS df FROM po GROUP BY ALL), raw AS (SELECT df.*, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN st {using}),
mi AS (SELECT {g}avg(raw) AS mean_idf FROM raw {'GROUP BY ' + on if group else ''}),
idf AS (SELECT {'raw.' + group + ', ' if group else ''}token, c * CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean_idf ELSE raw END AS idf, avgdl FROM raw JOIN mi {using} JOIN (VALUES {asked}) a(token, c) USING (token)),
scored AS (SELECT {'po.' + group + ', ' if group else ''}po.{doc}, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM po JOIN idf USING ({g}token) GROUP BY ALL)"""
