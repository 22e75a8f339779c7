"""The queries of this subpackage's operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keymoment.llm import chat, decontaminate, exact_dedup, html_text, license_scan, mixing, near_dedup, pii, toxicity, warc
from keymoment.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"), x["edits"].cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_notices", spans.alias("notice_spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each passage of a document that is a benchmark item within few edits."""
    out = decontaminate.mark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"], min_words=1)
    x = out.select("doc_id", F.explode("leaks").alias("x"))
    return x.select("doc_id", "x.item_id", F.col("x.first_word").cast("long").alias("first_word"), F.col("x.last_word").cast("long").alias("last_word"), F.col("x.start").cast("long").alias("start_char"), F.col("x.end").cast("long").alias("end_char"), F.col("x.edits").cast("long").alias("edits"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pii.scan_pii(docs, pii.train_field(docs), keep=["doc_id"])
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", pii.spans_text(F.col("found")).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_decontaminate, op3_near_dedup, op4_toxicity, op5_warc, op6_chat, op7_mixing, op8_exact_dedup, op9_html_text, op10_pii, pipeline)
}

ORACLE_SQL = {
    "op3_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 85 * (x.n + y.n - p.i)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to
FROM q LEFT JOIN f ON f.d = q.payload_digest
""",
    "op6_chat": """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role), md5(text)) AS pos FROM t),
c AS (SELECT conv_id, pos, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos) AS said FROM o),
f AS (SELECT conv_id, max(pos) AS n, max_by(said, pos) AS said FROM c GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, n, said FROM f GROUP BY n, said),
m AS (SELECT conv_id FROM k WHERE NOT EXISTS (SELECT 1 FROM c JOIN f USING (conv_id) WHERE c.pos = k.n AND f.n > c.pos AND c.said = k.said))
SELECT conv_id, CAST((pos - 1) // 1024 AS BIGINT) AS part, count(*) AS n_turns,
  string_agg('<|im_start|>' || translate(replace(role, '<|', '< |'), chr(13) || chr(10), '  ') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM o JOIN m USING (conv_id) GROUP BY ALL
""",
    "op7_mixing": r"""
WITH e AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents
), d AS (
  SELECT *, CAST(floor(1000 * size / (size + 200)) AS BIGINT) AS height,
    (CAST(CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM e
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * height) AS DOUBLE) AS heights FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0.0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open FROM w
  WINDOW b AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (SELECT max(CASE WHEN (rest / open) * weight > cap THEN cap / weight END) AS filled, arg_min(rest / open, cap / weight) FILTER (WHERE (rest / open) * weight <= cap) AS level FROM l),
t AS (SELECT source, source_size, heights, coalesce(least(weight * level, cap), cap) AS target FROM w, v),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS copies, CASE WHEN source_size > 0 THEN heights / (1000.0::DOUBLE * source_size) ELSE 0.0::DOUBLE END AS mean FROM t),
j AS (SELECT d.*, g.source_size, g.target, g.mean, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS p FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source),
o AS (SELECT *, p + 0.5::DOUBLE * least(p, 1 - p) * (CAST(height AS DOUBLE) / 1000.0::DOUBLE - mean) AS own FROM j),
r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (own / (1 - own)) END AS q FROM o),
m AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS LAST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS middle FROM r)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN p > 0 AND middle <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
""",
    "op8_exact_dedup": r"""
WITH n AS (SELECT doc_id, len(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS k, first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r
""",
}
