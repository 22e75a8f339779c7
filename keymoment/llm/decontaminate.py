"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

The symbols are words, or characters in scripts that are written without blanks. A CGK walk reads a word sequence with a pointer that moves on at step j if a random bit of (j, the
word under it) says so, and writes down the word at each step; few edits between two sequences leave most of the written
steps equal, so edit distance becomes Hamming distance. A sample of SYMBOLS steps is one LSH key. At every word of a
text, the window that starts there is walked and its key compared with those of the benchmark items of like length, for
SAMPLES samples of each of WALKS walks. Steps are sampled one from each of SYMBOLS equal spans of a walk, and a window is
followed only as long as its samples so far agree with some item's.

What the samples miss is found by pieces: an item of which k words may be edited is cut into k + 1 pieces, one of which
stands in the text unchanged, whatever the edits (pigeonhole). So no passage within EDITS edits a word is lost.

Windows that share a key or a piece with an item are verified: the item is aligned with the text around by edit distance
over words (bit-parallel), the start and end being free.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keymoment.llm.common import map_text

WALKS, SAMPLES, SYMBOLS = 5, 6, 5
#: Items of fewer words may have no edit. They can hardly be told from chance, so a caller has to ask for them (min_words).
MIN_WORDS = 5
#: An item is found within so many edits for each of its words.
EDITS = 0.2
#: Items of a length class differ in length by this factor at most.
CLASS_RATIO = 2
#: Words of a chunk of texts that is walked at once, and benchmark items that one pass over the texts looks for.
CHUNK_WORDS, BLOCK_ITEMS = 1 << 17, 20_000
_SEPARATE = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
# Characters of scripts without blanks (Thai, Lao, Tibetan, Myanmar, Khmer, Kana, Han, Yi), and their stops.
_STOP = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u303d\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\u0f0b-\u0f14\u104a-\u104f\u17d4-\u17da]")
_SCRIPT = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\ua4cf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_SYMBOL = re.compile(f"[{_SCRIPT}]|[^ {_SCRIPT}]+")
#: Bytes with which all of those begin.
_UNBLANKED = re.compile(rb"\xe0[\xb8-\xbf]|\xe1[\x80-\x82\x9e\x9f]|\xe2[\xba-\xbf]|[\xe3-\xe9]|\xea[\x80-\x93]|\xef[\xa4-\xab\xbc-\xbe]|\xf0[\xa0-\xbf]")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: What is said of a leak, beside the item's id.
LEAK = "first_word:int,last_word:int,start:int,end:int,edits:int"


def words_of(text: bytes) -> list[bytes]:
    """Words of letters and digits, ASCII lower-cased; other ASCII separates them. In scripts that are written without
    blanks, each character is a word, and stops separate."""
    flat = text.lower().translate(_SEPARATE)
    if flat.isascii() or np.frombuffer(flat, np.uint8).max() < 0xE0 or not _UNBLANKED.search(flat):
        return flat.split()
    return [w.encode("utf-8", "surrogateescape") for w in _SYMBOL.findall(_STOP.sub(" ", flat.decode("utf-8", "surrogateescape")))]


def places_of(text: bytes, words: list[bytes]) -> list[tuple[int, int]]:
    """(start, end) in bytes of the words of a text; between two there are none but separators."""
    flat, out, end = text.lower().translate(_SEPARATE), [], 0
    for w in words:
        start = flat.index(w, end)
        end = start + len(w)
        out.append((start, end))
    return out


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _bits(h: np.ndarray, walk: int, eight: int) -> np.ndarray:
    """A word's random bits at steps 8 * eight to 8 * eight + 7 of a walk, as bytes."""
    times = np.uint64(((2 * (walk * 64 + eight // 4) + 1) * int(_MULTIPLY) | 1) & (2**64 - 1))
    return ((h * times) >> np.uint64(32 + 8 * (eight % 4))).astype(np.uint8)


@dataclass
class _Sample:
    """steps, and for each number of leading steps the keys of the items' symbols there."""

    walk: int
    steps: list[int]
    keys: list[np.ndarray]
    items: dict[int, list[int]]

    def __post_init__(self):
        """begins, early: by 16 bits of the key of the first step, and of the first two, whether an item may have it."""
        self.begins, self.early = np.zeros((2, 1 << 16), bool)
        self.begins[_top(self.keys[0])] = True
        self.early[_top(self.keys[min(1, len(self.steps) - 1)])] = True

    def __reduce__(self):
        """The tables are made again where an index is sent to."""
        return _Sample, (self.walk, self.steps, self.keys, self.items)


@dataclass
class _Pieces:
    """The pieces of one number of words: their keys in order, and for each key the items and the places in them.
    begins, early: by the top bits of the key of a piece's first two words (or one), and of all, whether a piece may have it."""

    size: int
    keys: np.ndarray
    uses: list[list[tuple[int, int]]]
    begins: np.ndarray
    early: np.ndarray
    shift: int


class Index:
    """The items of a benchmark by length class, walk and sample, and by pieces."""

    def __init__(self, items: list[tuple[int, bytes]], seed: int = 5, min_words: int = MIN_WORDS):
        self.items = [(i, w) for i, t in items if len(w := words_of(t)) >= max(1, min_words)]
        self.sets = [frozenset(w) for _, w in self.items]
        rng = np.random.default_rng(seed)
        hashes = _Hashes()
        classes: dict[int, list[int]] = {}
        for n, (_, w) in enumerate(self.items):
            if len(w) >= MIN_WORDS:  # a shorter one is a piece as a whole
                classes.setdefault(int(math.log(len(w) / MIN_WORDS, CLASS_RATIO)), []).append(n)
        self.samples: list[_Sample] = []
        for _, members in sorted(classes.items()):
            least = min(len(self.items[n][1]) for n in members)
            span = max(SYMBOLS, int(1.6 * least))
            lengths = np.array([len(self.items[n][1]) for n in members])
            padded = np.zeros((len(members), lengths.max() + 1), np.uint64)
            for i, n in enumerate(members):
                padded[i, : lengths[i]] = [hashes[w] for w in self.items[n][1]]
            for walk in range(WALKS):
                walked = self._walked(padded, lengths, walk, span + SYMBOLS)
                for _ in range(SAMPLES):
                    # The first two steps come early, so that most windows are given up after a few steps.
                    cuts = [0, min(3, span // SYMBOLS + 1), min(8, 2 * span // SYMBOLS + 2)]
                    cuts += [round(cuts[2] + (span - cuts[2]) * k / (SYMBOLS - 2)) for k in range(1, SYMBOLS - 1)]
                    steps = sorted({int(rng.integers(a, max(a + 1, b))) for a, b in zip(cuts, cuts[1:], strict=False)})
                    keys = [np.zeros(len(members), np.uint64)]
                    for step in steps:
                        keys.append((keys[-1] ^ walked[step]) * _MULTIPLY + np.uint64(1))
                    found: dict[int, list[int]] = {}
                    for n, key in zip(members, keys[-1].tolist(), strict=True):
                        found.setdefault(key, []).append(n)
                    self.samples.append(_Sample(walk, steps, [np.unique(k) for k in keys[1:]], found))
        self.pieces = self._cut(hashes)
        self.first = max((s.steps[1] if len(s.steps) > 1 else s.steps[0] for s in self.samples), default=0)
        self.reach = max((s.steps[-1] for s in self.samples), default=0) + 1

    @staticmethod
    def _walked(padded: np.ndarray, lengths: np.ndarray, walk: int, steps: int) -> list[np.ndarray]:
        """The symbols that the walks of the items of a class write down at each step; 0 past an item's end."""
        out, at, rows = [], np.zeros(len(padded), np.intp), np.arange(len(padded))
        for j in range(steps):
            out.append(padded[rows, at])
            at = at + (((_bits(out[-1], walk, j // 8) >> np.uint8(j % 8)) & np.uint8(1)) & (at < lengths))
        return out

    def _cut(self, hashes: _Hashes) -> list[_Pieces]:
        """Pieces of all items, by their number of words: of each item one more than it may have edits."""
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        begins: dict[int, set[int]] = {}
        for n, (_, words) in enumerate(self.items):
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            cuts = [round(len(words) * i / (k + 1)) for k in (int(EDITS * len(words)),) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                keys = _rolled(h[a:b], b - a)
                begins.setdefault(b - a, set()).add(int(keys[min(2, b - a) - 1][0]))
                found.setdefault(b - a, {}).setdefault(int(keys[-1][0]), []).append((n, a))
        out = []
        for size, uses in sorted(found.items()):
            keys = np.array(sorted(uses), np.uint64)
            shift = 64 - min(24, max(16, len(keys).bit_length() + 5))
            tables = np.zeros((2, 1 << (64 - shift)), bool)
            tables[0, (np.array(list(begins[size]), np.uint64) >> np.uint64(shift)).astype(np.intp)] = True
            tables[1, (keys >> np.uint64(shift)).astype(np.intp)] = True
            out.append(_Pieces(size, keys, [uses[k] for k in keys.tolist()], *tables, shift))
        return out

    def piece_hits(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(position, item, place in the item) of the pieces in a word-hash sequence."""
        out = []
        for part in self.pieces:
            if len(h) < part.size:
                continue
            # Only places where two words begin a piece are read further.
            few = min(2, part.size)
            key = _rolled(h, few)[-1]
            at = np.flatnonzero(part.begins.take((key >> np.uint64(part.shift)).astype(np.intp)))
            at = at[at <= len(h) - part.size]
            key = key.take(at)
            for j in range(few, part.size):
                key = (key ^ h.take(at + j)) * _MULTIPLY + np.uint64(1)
            hit = np.flatnonzero(part.early.take((key >> np.uint64(part.shift)).astype(np.intp)))
            at, key = at.take(hit), key.take(hit)
            place = np.minimum(np.searchsorted(part.keys, key), len(part.keys) - 1)
            for q, k in zip(*(x[part.keys[place] == key].tolist() for x in (at, place)), strict=True):
                out += [(q, n, a) for n, a in part.uses[k]]
        return out

    def candidates(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(position, item) of the windows of a word-hash sequence that share a key with an item."""
        out: set[tuple[int, int]] = set()
        if not len(h) or not self.samples:
            return out
        n = len(h)
        padded = np.concatenate([h, np.zeros(self.reach + 1, np.uint64)])
        top = _top(padded * _MULTIPLY + np.uint64(1))
        for walk in range(WALKS):
            own = [s for s in self.samples if s.walk == walk]
            if not own:
                continue
            opened = max(s.steps[0] for s in own)
            places = [np.arange(n)]
            self._walk_on(places, padded, walk, opened)
            # Only windows that begin like an item in some sample are walked further.
            begins = [s.begins.take(top.take(places[s.steps[0]])) for s in own]
            open_ = np.flatnonzero(np.logical_or.reduce(begins))
            places = [x.take(open_) for x in places]
            self._walk_on(places, padded, walk, self.first)
            left, last = [], []
            for s, begun in zip(own, begins, strict=True):
                at = np.flatnonzero(begun.take(open_))
                key = padded.take(places[s.steps[0]].take(at)) * _MULTIPLY + np.uint64(1)
                if len(s.steps) > 1:
                    key = (key ^ padded.take(places[s.steps[1]].take(at))) * _MULTIPLY + np.uint64(1)
                hit = np.flatnonzero(s.early.take(_top(key)))
                at, key = at.take(hit), key.take(hit)
                left.append((np.arange(len(at)) + sum(map(len, last)), at, key))
                last.append(places[self.first].take(at))
            # What is left of all samples walks on together; each sample's steps thin its own part.
            where, j = np.concatenate(last), self.first
            for step, no, k in sorted((step, no, k) for no, s in enumerate(own) for k, step in enumerate(s.steps) if k > 1):
                part, at, key = left[no]
                if not len(part):
                    continue
                while j < step:
                    where += (_bits(padded.take(where), walk, j // 8) >> np.uint8(j % 8)) & np.uint8(1)
                    j += 1
                here = where.take(part) if step == j else places[step].take(at)
                key = (key ^ padded.take(here)) * _MULTIPLY + np.uint64(1)
                hit = np.flatnonzero(_among(key, own[no].keys[k]))
                left[no] = part.take(hit), at.take(hit), key.take(hit)
            for s, (_, at, key) in zip(own, left, strict=True):
                for p, x in zip(open_.take(at).tolist(), key.tolist(), strict=True):
                    out.update((p, item) for item in s.items.get(x, ()))
        return out

    @staticmethod
    def _walk_on(places: list[np.ndarray], padded: np.ndarray, walk: int, step: int) -> None:
        """Go on with a walk of many windows, from the last of their places to those at a step."""
        bits = None
        for j in range(len(places) - 1, step):
            if bits is None or j % 8 == 0:
                bits = _bits(padded, walk, j // 8)
            places.append(places[-1] + ((bits.take(places[-1]) >> np.uint8(j % 8)) & np.uint8(1)))

    def verify(self, words: list[bytes], p: int, item: int) -> tuple[int, int, int] | None:
        """(first word, last word, edits) of the best alignment of an item near a place, if its edits are few enough."""
        pattern = self.items[item][1]
        most = int(EDITS * len(pattern))
        a = max(0, p - most)
        part = words[a : p + len(pattern) + 2 * most]
        # Each word of the item that the text lacks is an edit at least.
        if len(self.sets[item].difference(part)) > most:
            return None
        edits, end = _align(pattern, part)
        if edits > most:
            return None
        _, back = _align(pattern[::-1], part[:end][::-1])
        return a + end - back, a + end - 1, edits


def _top(h: np.ndarray) -> np.ndarray:
    """The top 16 bits of hashes."""
    return (h >> np.uint64(48)).astype(np.intp)


def _rolled(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The keys of the sequences of 1 to size words, by where they begin."""
    keys = [h * _MULTIPLY + np.uint64(1)]
    for j in range(1, size):
        keys.append((keys[-1][:-1] ^ h[j:]) * _MULTIPLY + np.uint64(1))
    return keys


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each of x is in an ordered array."""
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _align(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """The least edit distance of the pattern to a part of the text, and the (first) end of such a part."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | (1 << i)
    plus, minus, score = mask, 0, m
    best, end = m, 0
    for j, w in enumerate(text, 1):
        e = eq.get(w, 0)
        x = (((e & plus) + plus) ^ plus) | e | minus
        up, down = minus | (~(x | plus) & mask), plus & x
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & mask, (down << 1) & mask
        v = e | minus
        plus, minus = (down | (~(v | up) & mask)) & mask, up & v
        if score < best:
            best, end = score, j
    return best, end


def find_leaks(texts: list[bytes], index: Index, hashes: _Hashes) -> list[list[dict]]:
    """For each text its passages that are a benchmark item within few edits; those of one item don't overlap."""
    out: list[list[dict]] = [[] for _ in texts]
    split = [words_of(t) for t in texts]
    group: list[int] = []
    total = 0
    for n in range(len(texts) + 1):
        if n < len(texts):
            group.append(n)
            total += len(split[n])
        if group and (total >= CHUNK_WORDS or n == len(texts)):
            flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(split[k] for k in group)), np.uint64, total)
            starts = np.concatenate([[0], np.cumsum([len(split[k]) for k in group])])
            places = set()
            for a in range(0, total, 2 * CHUNK_WORDS):  # a text of more words is walked in pieces
                places.update((p + a, item) for p, item in index.candidates(flat[a : a + 2 * CHUNK_WORDS + index.reach]) if p < 2 * CHUNK_WORDS)
            near = sorted(places)
            owners = (np.searchsorted(starts, [p for p, _ in near], side="right") - 1).tolist()
            tries = {(k, p - int(starts[k]), item) for (p, item), k in zip(near, owners, strict=True)}
            # A piece is of the text that it stands in, though the item's window may begin before that text.
            hits = index.piece_hits(flat)
            owners = (np.searchsorted(starts, [q for q, _, _ in hits], side="right") - 1).tolist()
            tries.update((k, q - int(starts[k]) - a, item) for (q, item, a), k in zip(hits, owners, strict=True))
            for k, p, item in sorted(tries):
                if hit := index.verify(split[group[k]], p, item):
                    out[group[k]].append({"item_id": index.items[item][0], "first_word": hit[0], "last_word": hit[1], "edits": hit[2]})
            group, total = [], 0
    for n, hits in enumerate(out):
        if not hits:
            continue
        at = places_of(texts[n], split[n])
        kept: list[dict] = []
        taken: dict[int | None, list[tuple[int, int]]] = {}
        for x in sorted(hits, key=lambda x: (x["item_id"] is None, x["item_id"], x["edits"], x["first_word"])):
            own = taken.setdefault(x["item_id"], [])
            k = bisect(own, (x["first_word"], len(at)))
            if (k == 0 or own[k - 1][1] < x["first_word"]) and (k == len(own) or own[k][0] > x["last_word"]):
                own.insert(k, (x["first_word"], x["last_word"]))
                kept.append(x)
        out[n] = sorted(kept, key=lambda x: (x["first_word"], x["item_id"] is None, x["item_id"]))
        start = before = 0
        for x in out[n]:
            a, b = at[x["first_word"]][0], at[x["last_word"]][1]
            start, before = start + len(texts[n][before:a].decode("utf-8", "replace")), a
            x |= {"start": start, "end": start + len(texts[n][a:b].decode("utf-8", "replace"))}
    return out


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """Append leaks to each row: passages within EDITS edits a word of a benchmark item, with words, code points, edits.

    The benchmark is a query set: it goes to every task, in blocks of BLOCK_ITEMS items, each block being one pass over
    the texts, which are searched whole and not shuffled. Items' ids may be of any type that can be ordered. Null or empty texts and items, and items under min_words words,
    match nothing, items under MIN_WORDS words their exact word sequence only; items with equal texts are all reported, as are repeated rows of docs. A column of docs named leaks is
    replaced. Empty tables give no leaks.
    """
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).where(F.col("t").isNotNull()).orderBy("i", "t")
    kind = f"array<struct<item_id:{benchmark.schema[item_col].dataType.simpleString()},{LEAK}>>"
    rows = ((r["i"], r["t"].encode()) for r in items.toLocalIterator())
    out, names = docs, []
    while (block := list(islice(rows, BLOCK_ITEMS))) or not names:
        # Made once here, unpacked once a worker: an index is of at most BLOCK_ITEMS items.
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, min_words=min_words))

        def make(shared=shared):
            index, hashes = shared.value, _Hashes()
            return lambda texts: [find_leaks(texts, index, hashes)]

        names.append(f"__leaks_{len(names)}")
        # The texts go on to the next pass only.
        also = [text_col] if len(block) == BLOCK_ITEMS else []
        out = map_text(out, text_col, make, [(names[-1], kind)], None if keep is None else [*dict.fromkeys([*keep, *also]), *names[:-1]])
        if len(block) < BLOCK_ITEMS:
            break
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c.lower() != "leaks"]
    return out.select(*kept, (F.col(names[0]) if len(names) == 1 else F.flatten(F.array(*names))).alias("leaks"))
