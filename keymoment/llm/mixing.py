"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target over its size is the number of copies that its documents are due on average. Whole copies are certain;
the fraction left, p, is shared out as inclusion probabilities that differ between documents: longer ones have more, so
that few documents make up the words, and the words expected are still p times the source's. Documents of a source are
ranked by random odds over inclusion odds, (U / (1 - U)) / (p_i / (1 - p_i)), and the sample is the start of that order
whose words come nearest to what is left of the target: a sample of fixed size in words.

The cut is found without a source's rows in one task: words are summed by bins of the rank, a bin holding a bounded number
of documents however many the source has; a running sum over bins finds the bin of the cut, and only that bin is ordered.
Rows of equal rank (the same id and text) are one there; how many of them are taken is counted, and which by their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keymoment.llm.common import Scratch, located

#: Documents of a source that a bin holds on average: so many, or ten times the root of the source's number if more.
BIN_DOCS = 1000
#: The size in words at which a document's probability is half-way between those of the shortest and the longest, and the
#: share of p (or of 1 - p) by which probabilities may differ.
HALF_WORDS, TILT = 200, 0.5


def size_of(text: Column) -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+; of null, 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, digest: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id (null as ''), the text's digest and the seed alone."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest).cast("binary"))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _height(size: Column) -> Column:
    """0 to 999, by size: whole numbers, so that their sums are the same in any order."""
    return F.floor(F.lit(1000) * size / (size + HALF_WORDS)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes(source, source_size, n_docs, heights) with target, whole copies, p and the mean height of a word.

    Sources, by code point and null last, weigh weights in turn. They share `share` of all words; none gets more than
    `most` times its size, and the excess is shared again: target = min(weight * level, most * size), the level being
    that at which all is given out. One row a source; the order of sources is over that table alone.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (turn + 1).cast("int"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everywhere = Window.partitionBy()
    t = sizes.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("all", F.lit(share) * F.sum("source_size").over(everywhere))
    t = t.withColumn("given", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("level", (F.col("all") - F.col("given")) / F.col("open"))
    # The first source, in order of the level at which it is full, that its own level doesn't fill sets the level.
    t = t.withColumn("at", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("given"), F.col("level")))).over(everywhere))
    t = t.withColumn("target", F.coalesce(F.least(F.col("weight") * F.col("at.level"), F.col("cap")), F.col("cap")))
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    return t.withColumn("copies", copies).select("source", "source_size", "n_docs", "target", F.floor("copies").cast("long").alias("sure"), (F.col("copies") - F.floor("copies")).alias("p"), F.coalesce(F.try_divide(F.col("heights").cast("double"), 1000.0 * F.col("source_size")), F.lit(0.0)).alias("mean"))


def _key() -> Column:
    """What a source's rows are ordered by: their rank, then id (null last) and digest of the text."""
    p, u = F.col("p"), F.col("u")
    own = p + TILT * F.least(p, 1 - p) * (_height(F.col("size")) / 1000.0 - F.col("mean"))
    return F.struct(F.try_divide(u / (1 - u), own / (1 - own)).alias("rank"), F.col("id").isNull().alias("no_id"), "id", "digest")


def _bin() -> Column:
    """The bin of a row's rank. Multiplied by the odds of p, ranks are spread much as U is."""
    odds = F.col("key.rank") * F.try_divide(F.col("p"), 1 - F.col("p"))
    return F.least(F.floor(odds / (1 + odds) * F.col("bins")), F.col("bins") - 1)


def _spot(bins) -> Column:
    """A row's bin by its place."""
    return F.pmod(F.xxhash64("file", "row"), bins)


def described(rows: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """rows of a located() table with id, source, size, digest and u."""
    text = F.col(f"whole.`{text_col}`")
    out = rows.select("*", F.col(f"whole.`{id_col}`").alias("id"), F.col(f"whole.`{source_col}`").cast("string").alias("source"), size_of(text).alias("size"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"))
    return out.withColumn("u", uniform(F.col("id"), F.col("digest"), seed))


def plan(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """For each source of described rows its target and where its sample ends."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.sum(F.col("size") * _height(F.col("size"))).alias("heights"))
    bins = F.greatest(F.lit(1.0), F.ceil(F.col("n_docs") / F.greatest(F.lit(float(BIN_DOCS)), 10 * F.sqrt("n_docs")))).cast("long")
    goal = scratch.keep(targets(sizes, weights, share, most).withColumn("bins", bins), "targets")
    asked = goal.where("p > 0").select(F.col("source").alias("s"), "p", "mean", (F.col("target") - F.col("sure") * F.col("source_size")).alias("rest"), "bins")
    placed = rows.join(asked, rows["source"].eqNullSafe(asked["s"])).withColumn("key", _key()).withColumn("bin", _bin())
    sums = scratch.keep(placed.groupBy("s", "rest", "bin").agg(F.sum("size").alias("words")), "bins")
    upto = Window.partitionBy("s").orderBy("bin")
    run = sums.withColumn("sum", F.sum("words").over(upto))
    # The bin of the cut: the first after which the running sum exceeds what is asked for; without one all are taken.
    cut = run.where(F.col("sum") > F.col("rest")).groupBy("s").agg(F.min_by(F.struct("bin", (F.col("sum") - F.col("words")).alias("before")), "bin").alias("c"))
    cut = scratch.keep(cut.select(F.col("s").alias("cs"), F.col("c.bin").alias("cut_bin"), F.col("c.before").alias("before")), "cuts")
    # Its rows, equal ones together; of each, as many are taken as begin, by half their size, within what is asked for.
    inside = placed.join(cut, placed["s"].eqNullSafe(cut["cs"]) & (placed["bin"] == cut["cut_bin"])).groupBy("s", "before", "rest", "key").agg(F.first("size").alias("size"), F.count("*").alias("n"))
    ahead = F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.col("rest") - F.col("before") - ahead
    fit = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).otherwise(F.when(room >= 0, F.col("n")).otherwise(0))
    inside = inside.withColumn("fit", F.least(F.greatest(fit, F.lit(0)), F.col("n")))
    last = inside.where("fit > 0").groupBy("s").agg(F.max(F.struct("key", "fit", "n")).alias("last"))
    last = scratch.keep(last.select(F.col("s").alias("ls"), "last", F.ceil(F.col("last.n") / BIN_DOCS).alias("spots")), "lasts")
    # Of the last ones, where only some are taken, the first by place: again the bin of the cut, then the row.
    some = last.where("last.fit < last.n")
    tied = placed.join(some, placed["s"].eqNullSafe(some["ls"]) & (F.col("key") == F.col("last.key"))).select("ls", "last.fit", "spots", "file", "row", _spot(F.col("spots")).alias("spot"))
    counts = tied.groupBy("ls", "fit", "spot").agg(F.count("*").alias("n")).withColumn("sum", F.sum("n").over(Window.partitionBy("ls").orderBy("spot")))
    spot = scratch.keep(counts.where("sum >= fit").groupBy("ls").agg(F.min(F.struct("spot", (F.col("fit") - F.col("sum") + F.col("n")).alias("more"))).alias("c")).select(F.col("ls").alias("os"), F.col("c.spot").alias("last_spot"), F.col("c.more").alias("more")), "spots")
    place = F.struct("file", "row")
    final = tied.join(spot, tied["ls"].eqNullSafe(spot["os"]) & (F.col("spot") == F.col("last_spot"))).withColumn("r", F.row_number().over(Window.partitionBy("ls").orderBy(place)))
    final = scratch.keep(final.where("r = more").select(F.col("ls").alias("fs"), "last_spot", place.alias("last_place")), "places")
    out = goal.join(cut, goal["source"].eqNullSafe(cut["cs"]), "left").join(last, goal["source"].eqNullSafe(last["ls"]), "left").join(final, goal["source"].eqNullSafe(final["fs"]), "left")
    return scratch.keep(out.withColumn("bins", bins).withColumnRenamed("source", "s").drop("cs", "ls", "fs", "before"), "goal")


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Described rows with target, source_size and copies taken."""
    placed = rows.join(cuts, rows["source"].eqNullSafe(cuts["s"])).withColumn("key", _key()).withColumn("bin", _bin())
    spot = _spot(F.col("spots"))
    early = F.col("last_place").isNull() | (spot < F.col("last_spot")) | ((spot == F.col("last_spot")) & (F.struct("file", "row") <= F.col("last_place")))
    cut = F.when(F.col("last").isNull(), False).when(F.col("key") == F.col("last.key"), early).otherwise(F.col("key") < F.col("last.key"))
    chosen = F.when(F.col("p") == 0, False).when(F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")), True).when(F.col("bin") > F.col("cut_bin"), False).otherwise(cut)
    return placed.withColumn("copies", F.col("sure") + F.when(chosen, 1).otherwise(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: the id, size in words, source_size, target and taken, the words the mix takes.

    taken is a whole number of times the size, at most `most` times, rounded up to a whole number of copies. A null or
    empty text has size 0 and takes nothing; a null source is a source of its own, after all others; a source without words
    has target 0. Each row is decided by itself: rows with equal ids rank by their texts as well, and of rows equal in both
    as many are taken as fit. Other columns of docs are ignored, whatever their names. An empty table gives an empty one.
    The same ids, texts and seed give the same mix, however the rows are stored, but for which of several equal rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(described(located(docs, scratch), seed, id_col, text_col, source_col).drop("whole"), "sizes")
    out = _taken(rows, plan(rows, scratch, weights, share, most))
    scratch.drop_but("sizes", "goal")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, with all their columns and copies, the times that each is taken. A column
    named copies (in any case) is replaced. Texts are not shuffled: each row is held against its source's cut.
    """
    scratch = Scratch(docs.sparkSession)
    rows = described(located(docs, scratch), seed, id_col, text_col, source_col)
    cuts = plan(scratch.keep(rows.drop("whole"), "sizes"), scratch, weights, share, most)
    scratch.drop_but("located", "goal")
    return _taken(rows, cuts).where("copies > 0 AND size > 0").select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns if c.lower() != "copies"], "copies")
