"""Chat formatting of logged conversations, after cumulative snapshots are collapsed.

A client that logs the whole conversation after each reply leaves conversations that are prefixes of longer ones. A
rolling hash of each conversation's turns so far (role and text at each place, 124 bits) makes prefixes comparable; a
conversation whose whole hash is another's prefix hash is dropped by an anti-join, and of equal ones the smallest id
stays. What is left is maximal and gets rendered.

Turns are sorted by ranges of (conversation, turn), so a long conversation lies in several tasks, however its turns are
numbered; places and hashes are running sums, over the ranges of a conversation and then within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keymoment.llm.common import Scratch

#: Turns that one row renders at most.
PART_TURNS = 1024
_PARTS = 4


def chatml(role: Column, text: Column) -> Column:
    """A turn in ChatML. Control marks inside are broken up ("<|" becomes "< |") and a role is one line, so that no text
    can end its turn or begin another."""
    safe = lambda x: F.replace(x, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), F.translate(safe(role), "\r\n", "  "), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def ordered_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, conv_id, role, text, range, at, size, h0..h3): distinct turns with their place from 1, the conversation's
    number of turns and its hash up to there."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    alone = F.concat(F.lit("row "), F.md5(F.concat_ws("\x1f", F.coalesce(F.col("turn").cast("string"), F.lit("")), role, text).cast("binary")))
    key = F.coalesce(F.concat(F.lit("id "), F.col("conv_id").cast("string")), alone)
    t = turns.select(key.alias("key"), "conv_id", "turn", role.alias("role"), text.alias("text")).distinct()
    # Ranges are told by short values only, as a sample of them goes to the driver.
    t = t.withColumn("digest", F.md5(F.col("text").cast("binary"))).repartitionByRange("key", "turn", F.md5(F.col("role").cast("binary")), "digest")
    t = scratch.keep(t.withColumn("range", F.spark_partition_id()), "turns")
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = t.groupBy("key", "range").agg(F.count("*").alias("n"))
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("size", F.sum("n").over(Window.partitionBy("key"))).select("key", "range", "ahead", "size")
    inside = Window.partitionBy("key", "range").orderBy("turn", F.md5(F.col("role").cast("binary")), "digest")
    t = t.join(counts, ["key", "range"]).withColumn("at", F.col("ahead") + F.row_number().over(inside))
    digest = F.md5(F.concat_ws("\x1f", F.col("at").cast("string"), "role", "text").cast("binary"))
    t = t.withColumns({f"p{i}": F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(_PARTS)})
    t = scratch.keep(t.select("key", "conv_id", "role", "text", "range", "at", "size", *[f"p{i}" for i in range(_PARTS)]), "placed")
    scratch.drop("turns")
    sums = t.groupBy("key", "range").agg(*[F.sum(f"p{i}").alias(f"s{i}") for i in range(_PARTS)])
    sums = sums.select("key", "range", *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"a{i}") for i in range(_PARTS)])
    run = Window.partitionBy("key", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(sums, ["key", "range"])
    return t.select("key", "conv_id", "role", "text", "at", "size", *[(F.col(f"a{i}") + F.sum(f"p{i}").over(run)).alias(f"h{i}") for i in range(_PARTS)])


def maximal(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(placed, kept): the turns as of ordered_turns, and the keys of the maximal conversations."""
    hashes = [f"h{i}" for i in range(_PARTS)]
    placed = scratch.keep(ordered_turns(turns, scratch), "hashed")
    whole = placed.where("at = size").groupBy("size", *hashes).agg(F.min(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id", "key")).alias("first")).select("size", *hashes, F.col("first.key").alias("key"))
    whole = scratch.keep(whole, "whole")
    part = scratch.keep(placed.where("at < size").select(F.col("at").alias("size"), *hashes).distinct(), "prefixes")
    kept = scratch.keep(whole.join(part, ["size", *hashes], "left_anti").select("key"), "kept")
    scratch.drop_but("hashed", "kept")
    return placed, kept


def format_conversations(turns: DataFrame, render=chatml, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, text) of each maximal conversation of turns(conv_id, turn, role, text, ...).

    text renders the turns in order, part_turns to a row; a longer conversation goes on in rows of the next part, so that
    no row gathers without bound. How turns are numbered doesn't matter. They are ordered by number (null first), then by
    the MD5 of role and text; rows that repeat all four columns count once; null roles and texts are empty. Rows without
    conv_id are each a conversation of one turn. Of equal conversations the smallest id stays. Other columns are ignored.
    An empty table gives an empty one.
    """
    placed, kept = maximal(turns, Scratch(turns.sparkSession))
    part = F.floor((F.col("at") - 1) / F.lit(part_turns)).cast("long")
    rows = placed.join(kept, "key").select("key", "conv_id", part.alias("part"), "at", render(F.col("role"), F.col("text")).alias("said"))
    out = rows.groupBy("key", "conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "said"))).alias("all"))
    return out.select("conv_id", "part", F.size("all").cast("long").alias("n_turns"), F.array_join(F.transform("all", lambda x: x["said"]), "").alias("text"))
