"""BM25 (Okapi) over tokenised documents, of a corpus or of each group of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25(docs: DataFrame, doc: str, tokens, query: list[str], group: list[str] = ()) -> DataFrame:
    """(group..., doc, score) of documents with a token of the query; repeated query tokens count again.

    A token in more than half of the documents has negative idf and gets EPSILON times the mean idf of the vocabulary.
    With `group`, all statistics are those of the group. Only the query's postings are joined and scored.
    """
    group = list(group)
    times: dict[str, int] = {}
    for q in query:
        times[q] = times.get(q, 0) + 1
    # Exploding an array of one keeps the optimizer from copying the tokens' expression to wherever they are used.
    base = docs.select(*group, doc, F.explode(F.array(tokens)).alias("toks")).withColumn("dl", F.size("toks"))
    stats = base.groupBy(*group).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = base.select(*group, F.explode(F.array_distinct("toks")).alias("token")).groupBy(*group, "token").agg(F.count("*").alias("df"))
    df = df.join(F.broadcast(stats)) if not group else df.join(stats, group)  # one row, or one a group
    df = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    own = [F.sum("raw").alias("all"), F.count("*").alias("words"), F.first("avgdl").alias("avgdl"), F.map_from_entries(F.collect_list(F.when(F.col("token").isin(*times), F.struct("token", "raw")))).alias("asked")]
    idf = df.groupBy(*group).agg(*own)  # asked: the query's tokens at most
    # The query's postings come from each row's tokens; no other token is exploded or shuffled.
    def count_of(q: str):
        return F.size(F.filter("toks", lambda x: x == q))

    tf = F.array(*[F.struct(F.lit(q).alias("token"), F.lit(c).alias("c"), count_of(q).alias("tf")) for q, c in times.items()])
    hits = base.select(*group, doc, "dl", F.filter(tf, lambda x: x["tf"] > 0).alias("tf")).where(F.size("tf") > 0)
    hits = hits.join(F.broadcast(idf)) if not group else hits.join(idf, group)
    mean = F.col("all") / F.col("words")

    def part(x):
        raw = F.element_at("asked", x["token"])
        return F.when(raw < 0, EPSILON * mean).otherwise(raw) * x["c"] * x["tf"] * (K1 + 1) / (x["tf"] + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    return hits.select(*group, doc, F.round(F.aggregate(F.transform("tf", part), F.lit(0.0), lambda s, x: s + x), 9).alias("score"))


def top_hits(scored: DataFrame, doc: str, k: int) -> DataFrame:
    """The k best positive scores with rank from 1; ties by document."""
    from pyspark.sql import Window

    best = scored.where("score > 0").orderBy(F.desc("score"), doc).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), doc)))
