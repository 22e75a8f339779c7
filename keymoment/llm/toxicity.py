"""Toxicity: a linear softmax over averaged subword embeddings, embeddings and softmax trained jointly in numpy.

The bag of a span of words holds their character n-grams (of UTF-8 bytes, with word boundaries), hashed to a fixed number
of embedding rows. Unseen spellings share n-grams, and so vectors, with known ones. A text's score is that of its most
toxic window of a few words, so that a long text doesn't dilute an insult. Training is multiple-instance: of a toxic text
only its most toxic window counts as toxic, of another text its most toxic-looking windows count as clean.

Texts of any length train. Executors read them whole, and hand on their most toxic-looking windows and a few chosen by
chance: first by how the n-grams are spread over toxic and other texts, then, in the middle of the training, by the model
so far. So the driver holds windows only, a bounded number for each of a bounded number of texts.

The model is linear once averaged, so scoring needs one number for each embedding row: its projection on the difference
of the softmax's two columns.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keymoment.llm.common import Scratch, bounded_sample, map_text

GRAMS = (3, 4, 5, 6)
_MULTIPLY = np.uint32(0x01000193)
#: ASCII apart from letters and digits separates words, other bytes belong to them.
_SEPARATE = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A text's n-grams are made for so many bytes at a time; a longer run without separators than WORD_BYTES is several words.
BLOCK_BYTES, WORD_BYTES = 1 << 16, 256
FIELDS = [("score", "double"), ("predicted", "int")]


@dataclass(frozen=True)
class Settings:
    """sample_rows: at most so many labelled texts of each class train the model, chosen by a hash of the id, whatever
    their length; of each, `best` of the most toxic-looking windows and `others` chosen by chance reach the driver, twice.
    Scoring has no such bounds."""

    rows: int = 1 << 17
    width: int = 8
    window: int = 6
    sample_rows: int = 2000
    best: int = 8
    others: int = 4
    rounds: int = 12
    rate: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """projected: a score for each embedding row; bias: of an empty bag."""

    projected: np.ndarray
    bias: float
    window: int


def blocks(text: bytes, window: int) -> Iterator[list[bytes]]:
    """A text's words, in lists of bounded size; each begins with the last window - 1 words of the one before, so that
    every window of the text is in one list and only one."""
    flat = text.lower().translate(_SEPARATE)
    before: list[bytes] = []
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + BLOCK_BYTES, at + 2 * BLOCK_BYTES)
        end = end if end >= 0 else at + 2 * BLOCK_BYTES if len(flat) > at + 2 * BLOCK_BYTES else len(flat)
        words = flat[at:end].split()
        if any(len(w) > WORD_BYTES for w in words):
            words = [w[k : k + WORD_BYTES] for w in words for k in range(0, len(w), WORD_BYTES)]
        if words:
            before = before + words
            yield before
            before = before[max(0, len(before) - window + 1) :]
        at = end


def grams(words: list[bytes], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The embedding rows of the n-grams of words (one at least), and the word of each."""
    raw = np.frombuffer(b" %b " % b" ".join(words), np.uint8)
    space = raw == 32
    word = np.cumsum(space, dtype=np.int32) - 1
    h, inner = np.full(len(raw), 0x811C9DC5, np.uint32), np.zeros(len(raw), bool)
    ids, owner = [], []
    for n in range(1, max(GRAMS) + 1):
        m = len(raw) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ raw[n - 1 :]) * _MULTIPLY
        inner = inner[:m] | (space[n - 2 : n - 2 + m] if n > 2 else False)
        if n in GRAMS:
            at = np.flatnonzero(~inner)
            g = h[at] ^ (h[at] >> np.uint32(15))
            ids.append(((g * np.uint32(0x9E3779B1)) >> np.uint32(32 - rows.bit_length() + 1)).astype(np.int32))
            owner.append(np.minimum(word[at], len(words) - 1))
    return np.concatenate(ids), np.concatenate(owner)


def _windows_grams(windows: list[bytes], rows: int) -> list[np.ndarray]:
    """The embedding rows of the n-grams of each window; a text without windows has one, of one row."""
    if not windows:
        return [np.zeros(1, np.int32)]
    split = [w.split(b" ") for w in windows]
    ids, owner = grams([w for words in split for w in words], rows)
    window = np.repeat(np.arange(len(split)), [len(words) for words in split])[owner]
    return np.split(ids[np.argsort(window, kind="stable")], np.cumsum(np.bincount(window, minlength=len(split)))[:-1])


def _sums(words: list[bytes], values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the words, the sum of its n-grams' values and their number."""
    ids, owner = grams(words, len(values))
    total = np.concatenate([[0.0], np.cumsum(np.bincount(owner, values[ids], len(words)))])
    count = np.concatenate([[0.0], np.cumsum(np.bincount(owner, minlength=len(words)))])
    k = min(window, len(words))
    return total[k:] - total[:-k], count[k:] - count[:-k]


def probability(text: bytes, model: Model) -> float:
    """That of the most toxic window; of a text without words, that of an empty bag."""
    odds = None
    for words in blocks(text, model.window):
        total, count = _sums(words, model.projected, model.window)
        most = float((total / np.maximum(count, 1)).max())
        odds = most if odds is None else max(odds, most)
    return float(1 / (1 + np.exp(-np.clip((odds or 0.0) + model.bias, -30, 30))))


def candidates(text: bytes, values: np.ndarray, settings: Settings) -> tuple[list[bytes], list[bytes]]:
    """(best, others): the windows with the greatest sums of values, of stretches of window words one each, and some
    windows chosen by chance; the choice depends on the text alone."""
    s = settings
    best: list[tuple[float, int, bytes]] = []
    others: list[tuple[float, int, bytes]] = []
    rng, no = np.random.default_rng([s.seed, zlib.crc32(text)]), 0
    for words in blocks(text, s.window):
        total, _ = _sums(words, values, s.window)
        k = min(s.window, len(words))
        for a in range(0, len(total), k):
            b = a + int(total[a : a + k].argmax())
            no += 1
            heapq.heappush(best, (float(total[b]), -no, b" ".join(words[b : b + k])))
            if len(best) > s.best:
                heapq.heappop(best)
        few = min(s.others, len(total))
        for a, u in zip(rng.choice(len(total), few, replace=False).tolist(), (rng.random(few) ** (1 / len(total))).tolist(), strict=True):
            no += 1
            heapq.heappush(others, (u, -no, b" ".join(words[a : a + k])))
            if len(others) > s.others:
                heapq.heappop(others)
    return [w for _, _, w in sorted(best, reverse=True)], [w for _, _, w in others]


class Trainer:
    """Embeddings and softmax while they are trained, over bags: (label, best windows, other windows) of each text."""

    def __init__(self, settings: Settings, odds: np.ndarray):
        s = self.settings = settings
        self.odds, self.round = odds, 0
        self.rng = np.random.default_rng(s.seed)
        self.embed = self.rng.normal(0, 1 / s.width, (s.rows, s.width)).astype(np.float32)
        self.soft = self.rng.normal(0, 1 / s.width, (s.width, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seen = np.full(s.rows, 1e-6, np.float32)

    def projected(self) -> np.ndarray:
        return self.embed @ (self.soft[:, 1] - self.soft[:, 0])

    def model(self) -> Model:
        return Model(self.projected().astype(np.float64), float(self.bias[1] - self.bias[0]), self.settings.window)

    def run(self, bags: list[tuple[int, list[bytes], list[bytes]]], rounds: int) -> None:
        made = [_windows_grams([*best, *others], self.settings.rows) for _, best, others in bags]
        # The windows of all texts one behind the other; of each text, `few` are its best.
        few = [max(1, len(best)) for _, best, _ in bags]
        sizes = np.array([len(x) for own in made for x in own])
        flat = np.concatenate([x for own in made for x in own])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        first = np.concatenate([[0], np.cumsum([len(own) for own in made])]).tolist()
        for _ in range(rounds):
            scores = self.odds if self.round < 2 else self.projected()
            each = np.concatenate([np.add.reduceat(scores[flat[begins[a] : begins[min(a + 4096, len(sizes))]]], begins[a : a + 4096][: len(sizes) - a] - begins[a]) for a in range(0, len(sizes), 4096)])
            bag: list[tuple[np.ndarray, int]] = []
            for k, (y, _, others) in enumerate(bags):
                bag.append((made[k][int(each[first[k] : first[k] + few[k]].argmax())], y))
                if y == 0 and others:
                    bag.append((made[k][few[k] + int(self.rng.integers(len(others)))], 0))
            self._step(bag, scores)
            self.round += 1

    def _step(self, bag: list[tuple[np.ndarray, int]], scores: np.ndarray) -> None:
        s, embed = self.settings, self.embed
        # A toxic text in which no window looks toxic after a few rounds is likely mislabelled and counts little.
        said = np.array([scores[x].mean() if len(x) else 0 for x, _ in bag]) + (self.bias[1] - self.bias[0])
        cls = np.array([label for _, label in bag])
        weight = np.where((cls == 1) & (said < 0) & (self.round > 3), 0.05, 1.0)
        for label in (0, 1):
            weight[cls == label] *= 0.5 * len(bag) / weight[cls == label].sum()
        # Steps of 64 bags, and 16 steps at least, so that few texts train as well.
        for chunk in np.array_split(self.rng.permutation(len(bag)), max(len(bag) // 64, min(16, len(bag)))):
            ids = [bag[i][0] for i in chunk]
            sizes = np.array([max(1, len(x)) for x in ids], np.float32)
            flat, owner = np.concatenate(ids), np.repeat(np.arange(len(chunk)), [len(x) for x in ids])
            mean = np.zeros((len(chunk), s.width), np.float32)
            np.add.at(mean, owner, embed[flat])
            mean /= sizes[:, None]
            z = mean @ self.soft + self.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p.copy()
            g[np.arange(len(chunk)), cls[chunk]] -= 1
            g *= weight[chunk].astype(np.float32)[:, None]
            pull = (g @ self.soft.T) / sizes[:, None]
            rows, where = np.unique(flat, return_inverse=True)
            step = np.zeros((len(rows), s.width), np.float32)
            np.add.at(step, where, pull[owner])
            self.seen[rows] += (step**2).mean(1)
            embed[rows] -= s.rate * 0.3 * step / np.sqrt(self.seen[rows])[:, None]
            self.soft -= s.rate * (mean.T @ g) / len(chunk)
            self.bias -= s.rate * g.sum(0) / len(chunk)


def held_out(doc_id) -> F.Column:
    """Whether labels of this row must not train: crc32 of the id as text, modulo 5, is 0 (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _spread(texts: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(odds, numbers): by embedding row, how much likelier toxic texts have its n-grams than others; the numbers of
    texts by label. n-grams are counted in the tasks, and only the sums come to the driver, two for each row at most."""
    rows, window = settings.rows, settings.window

    def count(batches):
        df = np.zeros((2, rows + 1), np.int64)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = np.zeros(rows, bool)
                for words in blocks(text, window):
                    own[grams(words, rows)[0]] = True
                df[y, :rows] += own
                df[y, rows] += 1
        at = np.flatnonzero(df.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[0, at]), pa.array(df[1, at])], ["g", "n0", "n1"])

    sums = texts.select("y", "text").mapInArrow(count, "g int, n0 bigint, n1 bigint").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    df = np.zeros((2, rows + 1))
    df[:, sums["g"].to_numpy()] = sums["n0"].to_numpy(), sums["n1"].to_numpy()
    n, df = df[:, rows], df[:, :rows]
    odds = np.log((df[1] + 0.1) / (n[1] + 0.2)) - np.log((df[0] + 0.1) / (n[0] + 0.2))
    odds[df[1] < max(2, 0.005 * n[1])] = 0
    return odds, n


def _bags(texts: DataFrame, values: np.ndarray, settings: Settings) -> list[tuple[int, list[bytes], list[bytes]]]:
    """The label and the candidate windows of each text, in the order of the ids."""
    shared = texts.sparkSession.sparkContext.broadcast(values.astype(np.float32))

    def pick(batches):
        for batch in batches:
            own = [candidates(t, shared.value, settings) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            made = [pa.array(x, pa.list_(pa.binary())) for x in zip(*own, strict=True)] if own else [pa.array([], pa.list_(pa.binary()))] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["no", "y", "best", "others"])

    rows = texts.select("no", "y", "text").mapInArrow(pick, "no bigint, y int, best array<binary>, others array<binary>").toArrow()
    shared.destroy()
    order = np.argsort(rows["no"].to_numpy(), kind="stable")
    y, best, others = (rows[c].to_pylist() for c in ("y", "best", "others"))
    return [(y[i], best[i], others[i]) for i in order.tolist()]


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled rows whose id is not held out. Several labels of an id count as the largest,
    null ids and labels as none, several texts of an id as the one of least hash; texts train whole, whatever their
    length. The ids are chosen first, so only chosen texts are moved, and rows are bounded before anything reaches the
    driver. Without texts of both labels, the model says 0 or 1 for all."""
    s = settings
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isNotNull()).where(~held_out("__id"))
    marked = marked.groupBy("__id").agg(F.max("__y").cast("int").alias("__y"))
    chosen = None
    for y in (0, 1):
        part = bounded_sample(marked.where((F.col("__y") == 1) if y else (F.col("__y") != 1)), s.sample_rows, ["__id"], s.seed)
        chosen = part if chosen is None else chosen.unionByName(part)
    scratch = Scratch(docs.sparkSession)
    # At most 2 * sample_rows ids: the bound of this broadcast. Texts of one id are combined before the shuffle.
    mine = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__id")
    one = mine.groupBy("__id", "__y").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("t"))).alias("x"))
    texts = one.select(F.xxhash64("__id", F.lit(s.seed)).alias("no"), (F.col("__y") == 1).cast("int").alias("y"), F.col("x.t").alias("text"))
    texts = scratch.keep(texts, "texts")
    odds, n = _spread(texts, s)
    if not n.all():
        scratch.drop("texts")
        return Model(np.zeros(s.rows), 4.0 if n[1] else -4.0, s.window)
    trainer = Trainer(s, odds)
    half = s.rounds // 2
    bags = _bags(texts, odds, s)
    trainer.run(bags, half)
    again = _bags(texts, trainer.projected(), s)
    trainer.run([(y, list(dict.fromkeys(a + c)), b + d) for (y, a, b), (_, c, d) in zip(bags, again, strict=True)], s.rounds - half)
    scratch.drop("texts")
    return trainer.model()


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append score (0 to 1) and predicted (1 from 0.5) to each row.

    A null or empty text gets the score of an empty bag. Texts are scored whole, in their own task: nothing is shuffled
    and groups of copies or hot sources move no rows. Repeated rows get equal scores; columns named score or predicted
    are replaced; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.projected.astype(np.float32), model.bias, model.window))

    def make():
        projected, bias, window = shared.value
        own = Model(projected, bias, window)

        def score(texts: list[bytes]) -> list[list]:
            p = [probability(t, own) for t in texts]
            return [p, [int(x >= 0.5) for x in p]]

        return score

    return map_text(docs, text_col, make, FIELDS, keep)


def accuracy(scored: Iterator[tuple[float, int]]) -> float:
    """The share of (score, label) on the label's side of 0.5."""
    rows = list(scored)
    return sum((p >= 0.5) == bool(y) for p, y in rows) / max(1, len(rows))
