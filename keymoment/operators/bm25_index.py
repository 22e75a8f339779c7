"""BM25 at rest: postings, vocabulary and corpus figures as Parquet, built once and read by token.

Postings and vocabulary lie in folders by a hash of the token, and each file is sorted by that hash: a query reads the
folders of its tokens only, and of those the pages in which its tokens stand. Each task writes the postings of its own
texts, so that an index of texts whose ids are their own is built without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keymoment.operators.bm25 import B, EPSILON, K1

BUCKETS = 32
#: Queries of more tokens than this are joined by token alone, without naming tokens and folders in the scan.
NAMED = 1000
#: Tasks a core that write postings, at most: each leaves a file in every folder.
WRITERS = 8
#: Values that a Parquet scan looks for one by one; a longer list counts as a range to it.
LISTED = 10


def key(token) -> F.Column:
    return F.xxhash64(token)


def bucket(token) -> F.Column:
    return F.pmod(key(token), F.lit(BUCKETS)).cast("int")


@contextmanager
def _open_folders(spark: SparkSession) -> Iterator[None]:
    """While it holds, a task keeps a file open in each folder, so that rows needn't be sorted by folder, but by their key
    alone: one number, for which Spark has a radix sort."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    had = spark.conf.get(name, None)
    spark.conf.set(name, str(BUCKETS))
    try:
        yield
    finally:
        spark.conf.unset(name) if had is None else spark.conf.set(name, had)


def _counted(toks: DataFrame) -> DataFrame:
    """(token, doc, tf, dl) of toks(doc, toks), rows of one doc and length being counted together."""
    return toks.select("doc", F.size("toks").alias("dl"), F.explode("toks").alias("token")).groupBy("doc", "dl", "token").agg(F.count("*").cast("int").alias("tf")).select("token", "doc", "tf", "dl")


def write_index(docs: DataFrame, doc: str, tokens, path: str, sets: bool = False) -> None:
    """Write the index of docs under path: postings(bucket, key, token, doc, tf, dl), vocabulary(bucket, key, token, df, cf,
    raw) and corpus(n, avgdl, mean). raw is a token's idf before it is known whether it is negative, mean that of the
    vocabulary. sets: tokens holds none twice, so a text's postings are its tokens; only those of ids that several rows
    have are shuffled and counted.

    Texts are tokenised once; a token that most documents have is counted with partial sums."""
    spark = docs.sparkSession
    # Exploding an array of one keeps the optimizer from copying the tokens' expression to wherever they are used.
    tokenised = lambda d: d.select(F.col(doc).alias("doc"), F.explode(F.array(tokens)).alias("toks"))
    n = docs.count()
    if sets:
        again = docs.groupBy(F.col(doc).alias("again")).agg(F.count("*").alias("c")).where("c > 1").select("again")
        some = not again.isEmpty()
        own = docs.join(again, docs[doc].eqNullSafe(again["again"]), "left_anti") if some else docs
        own = tokenised(own).select("doc", F.size("toks").alias("dl"), F.explode("toks").alias("token")).select("token", "doc", F.lit(1).alias("tf"), "dl")
        posted = own.unionByName(_counted(tokenised(docs.join(again, docs[doc].eqNullSafe(again["again"]), "left_semi")))) if some else own.coalesce(WRITERS * spark.sparkContext.defaultParallelism)
    else:
        posted = _counted(tokenised(docs))
    posted = posted.select(bucket("token").alias("bucket"), key("token").alias("key"), "token", "doc", "tf", "dl")
    with _open_folders(spark):
        posted.sortWithinPartitions("key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        postings = spark.read.schema(posted.schema).parquet(f"{path}/postings")
        df = postings.groupBy("bucket", "key", "token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        df = df.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        df.sortWithinPartitions("key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/vocabulary")
    words = spark.read.schema(df.schema).parquet(f"{path}/vocabulary")
    length = F.coalesce(F.sum("cf") / F.lit(float(n or 1)), F.lit(0.0))
    words.agg(F.lit(n).cast("bigint").alias("n"), length.alias("avgdl"), F.coalesce(F.avg("raw"), F.lit(0.0)).alias("mean")).write.mode("overwrite").parquet(f"{path}/corpus")


def asked(spark: SparkSession, tokens: dict[str, list[str]]) -> DataFrame:
    """queries(query_id, token, c) of lists of tokens by query; repeated tokens count again."""
    rows = [(q, t, words.count(t)) for q, words in tokens.items() for t in dict.fromkeys(words)]
    return spark.createDataFrame(rows, "query_id string, token string, c int")


def score(spark: SparkSession, path: str, queries: DataFrame, doc_type: str = "bigint") -> DataFrame:
    """(query_id, doc, score) of the documents with a token of queries(query_id, token, c), a query set.

    A token in more than half of the documents has negative idf and gets EPSILON times the mean of the vocabulary."""
    words = spark.read.schema("key bigint, token string, df bigint, raw double, bucket int").parquet(f"{path}/vocabulary")
    postings = spark.read.schema(f"key bigint, token string, doc {doc_type}, tf int, dl int, bucket int").parquet(f"{path}/postings")
    names = queries.select("token", bucket("token").alias("b"), key("token").alias("k")).distinct().limit(NAMED + 1).collect()
    if len(names) <= NAMED:
        folders, tokens = sorted({r["b"] for r in names}), [r["token"] for r in names]
        keys = sorted({r["k"] for r in names})
        listed = [F.col("key").isin(*keys[i : i + LISTED]) for i in range(0, len(keys), LISTED)] or [F.lit(False)]
        words, postings = (t.where(F.col("bucket").isin(*folders) & reduce(or_, listed) & F.col("token").isin(*tokens)) for t in (words, postings))
    corpus = spark.read.parquet(f"{path}/corpus")
    idf = queries.join(words.select("token", "raw"), "token").join(F.broadcast(corpus))  # one row
    idf = idf.select("query_id", "token", "avgdl", (F.col("c") * F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))).alias("idf"))
    dl, tf = F.col("dl"), F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    hits = postings.select("token", "doc", "tf", "dl").join(idf, "token")
    return hits.groupBy("query_id", "doc").agg(F.round(F.sum(part), 9).alias("score"))
