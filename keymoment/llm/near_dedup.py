"""Near-duplicate groups by b-bit MinHash, with exact confirmation.

1. One pass over the texts makes the shingle set, its minima under HASHES hash functions, BANDS band keys of ROWS minima
   each, and the low BITS bits of SIGNED minima, packed into longs. Texts with equal word sequences are one class (node).
2. Band buckets with two or more classes are kept. In each, the class that meets the most others over all its buckets
   (of a family of edited copies, the one nearest to all) is the bucket's hub; the others are compared with the hub only.
3. A compared pair goes on if the similarity estimated from the packed bits, corrected for chance agreement, is not far
   below the threshold; full shingle sets then confirm it.
4. Buckets whose classes are still in several components are compared across components, but only where a bound allows
   a link: a shingle that no other class of any bucket has can't be shared, which caps the intersection. Pairs that
   pass it and the estimate are confirmed on full sets too.

A link is only missed when no band agrees, at similarity 0.85 with a chance of (1 - 0.85**5)**28 = 7e-8, or when the
estimate is SLACK too low, five standard deviations. No bucket is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keymoment.llm.common import Scratch, Sieve, located, map_text, without
from keymoment.llm.components import connected_components

WORDS = 5
BANDS, ROWS, BITS = 28, 5, 2
HASHES = BANDS * ROWS
SIGNED = 128
SLACK = 0.18
#: Texts whose shingle sets a task remembers while it confirms pairs.
REMEMBERED = 64
_rng = np.random.default_rng(20)
_TIMES = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MIX = _rng.integers(0, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (ROWS, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FIELDS = [("n_shingles", "bigint"), ("class", "binary"), ("bands", "array<bigint>"), ("bits", "array<bigint>")]


class _Hashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    return text.lower().split()


def shingles(words: list[bytes], hashes: _Hashes) -> np.ndarray:
    """The distinct 64-bit hashes of the word sequences of WORDS words, sorted; of fewer words, one for the whole."""
    if not words:
        return np.empty(0, np.uint64)
    n = min(WORDS, len(words))
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = (h ^ w[j : j + len(h)]) * _MIX[j]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def minima(s: np.ndarray) -> np.ndarray:
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 1024):
        np.minimum(low, (np.multiply.outer(x[start : start + 1024], _TIMES) + _PLUS).min(axis=0), out=low)
    return low


def signature(s: np.ndarray) -> tuple[list[int], list[int]]:
    """The band keys and the packed low bits of the minima."""
    low = minima(s)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = (key ^ low[r * BANDS : (r + 1) * BANDS]) * _BAND[r]
        key ^= key >> np.uint64(31)
    mixed = low * np.uint32(0x85EBCA6B)
    bits = (mixed ^ (mixed >> np.uint32(16)))[:SIGNED] & np.uint32((1 << BITS) - 1)
    packed = np.zeros(SIGNED * BITS // 64, np.uint64)
    for i, part in enumerate(bits.reshape(len(packed), -1).astype(np.uint64)):
        packed[i] = np.bitwise_or.reduce(part << (np.arange(len(part), dtype=np.uint64) * np.uint64(BITS)))
    return key.astype(np.int64).tolist(), packed.astype(np.int64).tolist()


def class_of(words: list[bytes]) -> bytes | None:
    """128 bits of a digest of the word sequence; equal sequences have equal shingle sets. None without words."""
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def _describe():
    hashes = _Hashes()

    def run(texts: list[bytes]) -> list[list]:
        sizes, classes, bands, bits = [], [], [], []
        for text in texts:
            words = words_of(text)
            s = shingles(words, hashes)
            b, p = signature(s) if len(s) else (None, None)
            sizes.append(len(s))
            classes.append(class_of(words))
            bands.append(b)
            bits.append(p)
        return [sizes, classes, bands, bits]

    return run


def _classes():
    return lambda texts: [[class_of(words_of(t)) for t in texts]]


def full_set(text: bytes) -> frozenset[bytes]:
    """The shingles themselves."""
    words = words_of(text)
    n = min(WORDS, len(words))
    return frozenset(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def _confirm(percent: int):
    def run(batches):
        known: dict[int, frozenset[bytes]] = {}

        def of(node: int, text) -> frozenset[bytes]:
            if node not in known:
                while len(known) >= REMEMBERED:
                    known.pop(next(iter(known)))
                known[node] = full_set(text.as_buffer().to_pybytes())
            return known[node]

        for batch in batches:
            keep = []
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())]
            for i, (a, b, x, y) in enumerate(zip(*columns, strict=True)):
                s, t = of(a, x), of(b, y)
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int32())) for k in (0, 1)], ["a", "b"])

    return run


def estimate(x: list, y: list) -> F.Column:
    """The similarity from packed low bits: the share of equal minima, corrected for those equal by chance."""
    differ = F.lit(0)
    ones = int("01" * 32, 2)
    for a, b in zip(x, y, strict=True):
        d = a.bitwiseXOR(b)
        differ = differ + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(ones)))
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / F.lit(float(SIGNED))) - chance) / (1 - chance)


def near_duplicate_rows(rows: DataFrame, scratch: Scratch, id_col: str, text_col: str, percent: int = 85) -> DataFrame:
    """(id, file, row, n_shingles, class, best) of each row of a located() table; best is the first row, by id (null last)
    and place, of all that links reach: a struct of no_id, id, file and row. Rows without words have none."""
    texts_in = rows.select(F.col(f"whole.`{id_col}`").alias("id"), "file", "row", F.col(f"whole.`{text_col}`").alias("text"))
    described = scratch.keep(map_text(texts_in, "text", _describe, FIELDS, keep=["id", "file", "row"]), "described")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")
    classes = described.where("class IS NOT NULL").groupBy("class").agg(F.min(place).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    # A short number for each class; written once, it stays the same whatever is run again.
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    signs = [f"s{i}" for i in range(SIGNED * BITS // 64)]
    about = classes.select("node", "n", *[F.col("bits")[i].alias(c) for i, c in enumerate(signs)])

    # Buckets that hold two classes or more.
    member = classes.select("node", F.explode("bands").alias("band"))
    shared = scratch.keep(member.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    member = scratch.keep(member.join(shared, "band").select("band", "node", "members"), "members")
    met = scratch.keep(member.groupBy("node").agg(F.sum("members").alias("met")), "met")
    wanted = scratch.keep(classes.select("node", "class").join(met, "node").select("node", "class"), "wanted")
    texts = _texts_of(texts_in.select("text"), wanted, scratch)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        full = full.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
        return scratch.keep(full.mapInArrow(_confirm(percent), "a bigint, b bigint"), name)

    def may_link(most) -> F.Column:
        return F.lit(100) * most >= F.lit(percent) * (F.col("na") + F.col("nb") - most)

    def near_enough() -> F.Column:
        return estimate([F.col(f"a_{c}") for c in signs], [F.col(f"b_{c}") for c in signs]) >= percent / 100 - SLACK

    def side(df: DataFrame, x: str, *more: str) -> DataFrame:
        return df.select(*[m for m in more if m == "band"], F.col("node").alias(x), F.col("n").alias(f"n{x}"), *[F.col(m).alias(f"{m}_{x}") for m in more if m != "band"], *[F.col(c).alias(f"{x}_{c}") for c in signs])

    # Each bucket's members against its hub.
    hubs = member.join(met, "node").groupBy("band").agg(F.max(F.struct("met", "node")).alias("hub")).select("band", F.col("hub.node").alias("b"))
    hubs = scratch.keep(hubs, "hubs")
    star = scratch.keep(member.join(hubs, "band").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "star")
    star = scratch.keep(star.join(side(about, "a"), "a"), "star-a").join(side(about, "b"), "b")
    star = scratch.keep(star.where(may_link(F.least("na", "nb")) & near_enough()).select("a", "b"), "star-near")
    links = confirmed(star, "star-links")
    roots = connected_components(links, scratch, "first")

    # What is left between components.
    placed = scratch.keep(member.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "placed")
    mixed = scratch.keep(placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band"), "mixed")
    own = map_text(texts, "text", _shingle_keys, [("keys", "array<int>")], keep=["node"]).select("node", F.explode("keys").alias("key"))
    own = own.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("own"))
    own = scratch.keep(own, "own")
    able = about.join(met.select("node"), "node").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    able = scratch.keep(able.where(F.lit(100) * (F.col("n") - F.col("own")) >= percent * F.col("n")), "able")
    able = scratch.keep(able.join(classes.select("node", F.transform("bands", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("all")), "node"), "able-bands")
    rest = scratch.keep(placed.join(mixed, "band").select("band", "node", "root"), "placed-mixed")
    rest = scratch.keep(rest.join(able, "node"), "rest")
    most = F.least(F.col("na") - F.col("own_a"), F.col("nb") - F.col("own_b"))
    # A pair is compared in the first bucket only that it shares.
    first = F.element_at(F.filter(F.zip_with("all_a", "all_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 1) == F.col("band").bitwiseAND(F.lit(0x7FFFFFFF))
    pairs = side(rest, "a", "band", "root", "own", "all").join(side(rest, "b", "band", "root", "own", "all"), "band").where((F.col("root_a") < F.col("root_b")) & may_link(most) & near_enough() & first)
    pairs = scratch.keep(pairs.select("a", "b").distinct(), "rest-near")
    roots = connected_components(links.union(confirmed(pairs, "rest-links")), scratch, "all")

    grouped = scratch.keep(classes.select("node", "class", "first").join(roots, "node", "left").select("class", "first", F.coalesce("root", "node").alias("root")), "grouped")
    least = scratch.keep(grouped.groupBy("root").agg(F.min("first").alias("best")), "least")
    groups = scratch.keep(grouped.join(least, "root").select("class", "best"), "groups")
    scratch.drop_but("located", "described", "groups")
    return described.select("id", "file", "row", "n_shingles", "class").join(groups, "class", "left")


def _texts_of(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, text) of the wanted classes, from one text of each. Texts that a sieve of the classes tells apart aren't
    shuffled, and equal ones are combined before the shuffle."""
    keyed = Sieve(wanted, "class").split(map_text(docs, "text", _classes, [("class", "binary")]), "class", passing=True)
    one = keyed.groupBy("class").agg(F.first("text").alias("text"))
    return scratch.keep(one.join(wanted, "class").select("node", "text"), "texts")


def _shingle_keys():
    """32 bits of each shingle's hash. Shingles that share them count as shared, which only loosens the bound."""
    hashes = _Hashes()
    return lambda texts: [[np.unique((shingles(words_of(t), hashes) & np.uint64(0x7FFFFFFF)).astype(np.int32)).tolist() for t in texts]]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row for each row of docs: the id, n_shingles, component_id (smallest id that links reach) and kept.

    Two texts link when 100 * |intersection| >= percent * |union| of their shingle sets. A null or empty text has no
    shingles and links with nothing: its component_id is its own id. Rows with the same id each get a row; kept is
    whether the id is the component's. A null id never names a component that has another id. Columns of docs other
    than the two are ignored, so their names may clash with the result's. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    out = near_duplicate_rows(located(docs, scratch), scratch, id_col, text_col, percent)
    out = out.withColumn("component_id", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("best.id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row of docs for each group of near-duplicates, with all its columns, whatever their names: that of the smallest
    id, null ids last, and of rows that share an id the first by locator. Rows without words all stay. Only rows to be
    dropped (and the few others that a sieve lets pass) are shuffled with their texts."""
    scratch = Scratch(docs.sparkSession)
    rows = located(docs, scratch)
    out = near_duplicate_rows(rows, scratch, id_col, text_col, percent)
    gone = out.where(F.col("class").isNotNull() & ~(F.col("file").eqNullSafe(F.col("best.file")) & F.col("row").eqNullSafe(F.col("best.row"))))
    gone = scratch.keep(gone.select("file", "row"), "gone")
    scratch.drop_but("located", "gone")
    return without(rows, gone)
