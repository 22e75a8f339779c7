"""Personal data: patterns, and a skip-chain conditional random field that labels each document's mentions alike.

Patterns find e-mail and IP addresses, card and phone numbers. The field's nodes are the tokens with a digit or an @ (all
others are clamped to no label, so they cut the chain). Its edges join tokens that stand side by side, and, as skip
edges, each token with the next one of the document that has the same text, the same last seven digits or the same local
part, and with the first such token of each kind that the patterns label, however far away it is. Tokens of the patterns'
spans have those labels for certain. Loopy message passing over both gives each token's label; labelled tokens outside the patterns' spans are added, so
that a number or address that a pattern knows in one place is found where it is written in another way.

The field's weights are trained in numpy by pseudo-likelihood on a bounded sample of texts that the patterns label.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keymoment.llm.common import bounded_sample, map_text

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole: a match can't begin within one, as it would have begun with it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_TRIGGER = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_WANTED = "@|[0-9]{3}"
#: A token's label must have this probability to add a span.
SURE = 0.9
#: Messages pass until none changes by more than this; the rounds only bound what would swing without end.
STILL, ROUNDS = 1e-3, 1000
#: The field is trained on pieces of so many characters, one of each of at most so many texts of any length.
SAMPLE_ROWS, PIECE_CHARS = 1000, 4000
SKIP_DIGITS, TEXT_DIGITS = 7, 4
#: In training, copies of each labelled token as a weak mention, and the share of a copy's features that are left out.
COPIES, LEFT_OUT = 3, 0.3
#: The log-odds of a label that is certain.
CERTAIN = 1e6
# Words before a token that hint at its kind.
HINTS = (("email", "mail", "e-mail", "contact"), ("ip", "host", "server", "address"), ("card", "credit", "visa", "mastercard"), ("phone", "tel", "telephone", "mobile", "fax", "call"), ("version", "v", "page", "no", "nr"))
FIELDS = [
    ("n_email", "bigint"), ("n_ip", "bigint"), ("n_card", "bigint"), ("n_phone", "bigint"), ("base_sha256", "string"),
    ("found", "array<struct<kind:string,start:int,end:int,base:boolean>>"),
]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches: for each kind the leftmost ones that don't overlap."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        begin = floor + len(text[floor:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        floor = at + 1
        if m:
            out.append((0, begin, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], x[0]))


@dataclass
class Graph:
    """Tokens of a text (starts, ends), the features of token n (features[at[n] : at[n + 1]]), and the edges of both sorts,
    two columns each. Flat arrays, as a text may hold a token in every few characters."""

    starts: np.ndarray
    ends: np.ndarray
    features: np.ndarray
    at: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


_NAMES: dict[str, int] = {}


def _feature(name: str) -> int:
    return _NAMES.setdefault(name, len(_NAMES))


for _n in ["bias", "@", "@.", "luhn", "quad", "+", "(", "-", "digits only", "letters", "hex", "=", "quote", "upper", "dot"] + [f"n{i}" for i in range(9)] + [f"hint{i}" for i in range(len(HINTS))]:
    _feature(_n)
N_FEATURES, N_LABELS = len(_NAMES), len(KINDS) + 1
#: Features that alone decide a pattern; a weak mention lacks them.
DECISIVE = frozenset(_NAMES[n] for n in ("@", "@.", "luhn", "quad", "+"))
_BOUNDS = (3, 4, 5, 9, 12, 16, 17, 20)


def _edges(flat: array) -> np.ndarray:
    return np.array(flat, np.int32).reshape(-1, 2)


def graph(text: str, base: list[tuple[int, int, int]] | None = None) -> Graph:
    """base: the patterns' spans; with them, mentions are joined with those that the patterns label."""
    starts, ends, features, at, chain, skip = (array("i") for _ in range(6))
    last: dict[int, int] = {}
    keyed, key_at = array("q"), array("i", [0])
    at.append(0)
    before, adjacent = "", False
    for m in _TOKEN.finditer(text):
        raw = m.group()
        if not _TRIGGER.search(raw):
            before, adjacent = raw, False
            continue
        core = raw.strip(".,;:!?\"'<>[]{}")
        a = m.start() + raw.find(core) if core else m.start()
        core = core or raw
        digits = _NO_DIGIT.sub("", core)
        f = ["bias", f"n{sum(len(digits) >= b for b in _BOUNDS)}"]
        if "@" in core:
            f.append("@")
            f += ["@."] * ("." in core.partition("@")[2])
        f += [c for c in "+(-=" if c in core] + ["dot"] * ("." in core) + ["quote"] * ('"' in raw or "'" in raw)
        f += ["luhn"] * (12 <= len(digits) <= 19 and luhn(digits))
        f += ["quad"] * bool("." in core and _IP.fullmatch(core) and all(int(p[-4:]) <= 255 for p in core.split(".")))
        letters = [c for c in core if c.isalpha()] if len(digits) < len(core) else []
        f.append("letters" if letters else "digits only")
        f += ["upper"] * (bool(letters) and core.upper() == core) + ["hex"] * (len(letters) > 3 and len(digits) > 3 and set(core.lower()) <= set("0123456789abcdef"))
        hint = before.strip(":.,").lower()
        f += [f"hint{i}" for i, words in enumerate(HINTS) if hint in words]
        n = len(starts)
        starts.append(a)
        ends.append(a + len(core))
        features.extend(_NAMES[x] for x in f)
        at.append(len(features))
        if adjacent:
            chain.extend((n - 1, n))
        local = core.partition("@")[0].lower()
        # A few digits, as of a number's parts, stand for many things and join nothing.
        known_by = (f"t{core}" if len(digits) >= TEXT_DIGITS or "@" in core else "", f"d{digits[-SKIP_DIGITS:]}" if len(digits) >= SKIP_DIGITS else "", f"l{local}" if len(local) > 4 and letters else "")
        keys = {xxhash.xxh3_64_intdigest(k) >> 1 for k in known_by if k}
        for j in {last[k] for k in keys if k in last}:
            skip.extend((j, n))
        last.update(dict.fromkeys(keys, n))
        keyed.extend(keys)
        key_at.append(len(keyed))
        before, adjacent = raw, True
    g = Graph(*(np.array(x, np.int32) for x in (starts, ends, features, at)), _edges(chain), _edges(skip))
    if base:
        labels = token_labels(g, base)
        known: dict[int, dict[int, int]] = {}
        for n in np.flatnonzero(labels).tolist():
            for k in keyed[key_at[n] : key_at[n + 1]]:
                known.setdefault(k, {}).setdefault(int(labels[n]), n)
        more = {(min(j, n), max(j, n)) for n in np.flatnonzero(labels == 0).tolist() for k in keyed[key_at[n] : key_at[n + 1]] if k in known for j in known[k].values()} if known else ()
        if more:
            g.skip = np.unique(np.concatenate([g.skip, np.array(sorted(more), np.int32)]), axis=0)
    return g


@dataclass(frozen=True)
class Field:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray


def token_labels(g: Graph, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of each token by the patterns' spans that it overlaps; 0 without one."""
    out = np.zeros(len(g.starts), np.int8)
    for kind, a, b in spans:
        n = max(0, int(np.searchsorted(g.ends, a, side="right")))
        while n < len(out) and g.starts[n] < b:
            out[n] = out[n] or kind + 1
            n += 1
    return out


def train(texts: list[str], steps: int = 400, rate: float = 0.5, seed: int = 3) -> Field:
    """Pseudo-likelihood over the texts' tokens, labelled by the patterns.

    The patterns see no weak mentions, so these are made of tokens that they label: copies without the decisive features
    and some others, joined by a skip edge to the token that they are another mention of. As many tokens without a label
    get copies in the same way, so that the skip potential is learnt from repetitions of both sorts."""
    rng = np.random.default_rng(seed)
    xs, ys, nears = [], [], []
    for text in texts:
        base = base_spans(text)
        g = graph(text, base)
        y = token_labels(g, base)
        near = np.zeros((len(y), 3, N_LABELS), np.float32)
        for edges, (back, there) in ((g.chain, (0, 1)), (g.skip, (2, 2))):
            np.add.at(near, (edges[:, 1], back, y[edges[:, 0]]), 1)
            np.add.at(near, (edges[:, 0], there, y[edges[:, 1]]), 1)
        x = np.zeros((len(y), N_FEATURES), np.float32)
        x[np.repeat(np.arange(len(y)), np.diff(g.at)), g.features] = 1
        marked = np.flatnonzero(y)
        plain = np.flatnonzero(y == 0)
        copied = np.repeat(np.concatenate([marked, rng.choice(plain, min(len(plain), max(1, len(marked))), replace=False)]), COPIES)
        weak, by = x[copied], near[copied]
        weak[:, list(DECISIVE)] = 0
        weak[:, 1:] *= rng.random((len(copied), N_FEATURES - 1)) >= LEFT_OUT
        by[rng.random(len(copied)) < 0.5, :2] = 0
        by[np.arange(len(copied)), 2, y[copied]] += 1
        xs += [x, weak]
        nears += [near, by]
        ys += [y, y[copied]]
    unary, chain, skip = np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    labels = np.concatenate(ys) if ys else np.zeros(0, np.int8)
    if not labels.any():
        unary[_NAMES["bias"], 0] = 10
        return Field(unary, chain, skip)
    x, near = np.concatenate(xs), np.concatenate(nears)
    le, ri, sk = (np.ascontiguousarray(near[:, k]) for k in range(3))
    y = np.eye(N_LABELS)[labels]
    moments = [np.full_like(unary, 1e-3), np.full_like(chain, 1e-3), np.full_like(skip, 1e-3)]
    for _ in range(steps):
        z = x @ unary + le @ chain + ri @ chain.T + sk @ skip
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - y) / len(y)
        grads = [x.T @ d + 1e-4 * unary, le.T @ d + (ri.T @ d).T + 1e-4 * chain, sk.T @ d + 1e-4 * skip]
        for w, gr, m in zip((unary, chain, skip), grads, moments, strict=True):
            m += gr**2
            w -= rate * gr / np.sqrt(m)
    return Field(unary, chain, (skip + skip.T) / 2)


def _passed(v: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Messages of sources with log beliefs v over edges of one potential."""
    v -= v.max(1, keepdims=True)
    new = np.log(np.exp(v, out=v) @ pair)
    return new - new.max(1, keepdims=True)


def marginals(g: Graph, field: Field, rounds: int = ROUNDS, known: np.ndarray | None = None) -> np.ndarray:
    """Each token's label probabilities, by sum-product messages over chain and skip edges, damped, until they stay.
    known: labels that are certain, 0 where none is. All edges of a sort share one potential, so a message takes a row of
    five numbers and memory is in proportion to tokens and edges."""
    node = np.add.reduceat(field.unary[g.features], g.at[:-1]).astype(np.float32) if len(g.starts) else np.zeros((0, N_LABELS), np.float32)
    if known is not None:
        node[known > 0] = CERTAIN * np.eye(N_LABELS, dtype=np.float32)[known[known > 0]]
    sorts = []
    for edges, potential in ((g.chain, field.chain), (g.skip, field.skip)):
        if len(edges):
            pair = np.exp(np.clip(potential, -50, 50)).astype(np.float32)
            sorts.append((edges[:, 0], edges[:, 1], pair, *(np.zeros((len(edges), N_LABELS), np.float32) for _ in range(2))))
    awake = np.ones(len(node), bool)
    for _ in range(rounds):
        # Only edges of tokens whose beliefs still move are worked on; all messages of a round rest on the same beliefs.
        before, moved = node.copy(), False
        for left, right, pair, there, back in sorts:
            at = np.flatnonzero(awake[left] | awake[right])
            if not len(at):
                continue
            moved = True
            a, b = left[at], right[at]
            new = (_passed(before[a] - back[at], pair), _passed(before[b] - there[at], pair.T))
            for messages, to, x in zip((there, back), (b, a), new, strict=True):
                x -= messages[at]
                x *= 0.5
                messages[at] += x
                np.add.at(node, to, x)
        if not moved:
            break
        np.subtract(node, before, out=before)
        awake = np.abs(before, out=before).max(1) > STILL
    p = np.exp((node - node.max(1, keepdims=True)).astype(np.float64))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the field labels outside the patterns' spans; tokens side by side become one."""
    g = graph(text, base)
    if not len(g.starts):
        return []
    known = token_labels(g, base)
    covered = known > 0
    if covered.all():
        return []
    p = marginals(g, field, known=known)
    beside = set(g.chain[:, 1].tolist())
    out: list[tuple[int, int, int]] = []
    previous = -2
    for n in np.flatnonzero(~covered & (p[:, 0] < 1 - SURE)).tolist():
        label = int(p[n, 1:].argmax())
        if p[n, label + 1] < SURE:
            continue
        a, b = int(g.starts[n]), int(g.ends[n])
        if previous == n - 1 and n in beside and out and out[-1][0] == label:
            out[-1] = (label, out[-1][1], b)
        else:
            out.append((label, a, b))
        previous = n
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def scan_text(text: str, field: Field) -> tuple:
    if not _TRIGGER.search(text):
        return 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), []
    base = base_spans(text)
    n = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
    more = added_spans(text, base, field)
    every = sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda x: (x[1], x[0], x[2]))
    return *n, hashlib.sha256(joined(base).encode()).hexdigest(), [{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in every]


def train_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = PIECE_CHARS) -> Field:
    """Train on at most `rows` texts with an @ or many digits, chosen by a hash, whatever their length: of each, on one
    piece of `chars` characters with such, chosen by a hash as well."""
    t = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").rlike(_WANTED))
    starts = F.sequence(F.lit(0), F.floor((F.char_length("t") - 1) / F.lit(chars)))
    pieces = F.filter(F.transform(starts, lambda k: F.substring(F.col("t"), (k * chars + 1).cast("int"), F.lit(chars))), lambda x: x.rlike(_WANTED))
    n = F.size("pieces")
    some = F.when(n > 0, F.col("pieces")[F.pmod(F.xxhash64("i", F.lit(1)), F.greatest(n, F.lit(1)))]).otherwise("")
    got = bounded_sample(t, rows, ["i", "t"], pick=lambda df: df.withColumn("pieces", pieces).select("i", some.alias("t"), "__order")).collect()
    return train([r["t"] for r in sorted(got, key=lambda r: (r["i"] is None, r["i"], r["t"]))])


def scan_pii(docs: DataFrame, field: Field, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the counts of the patterns' spans, base_sha256 (of those spans as text) and found (all spans, code points).

    A null or empty text has none; its base_sha256 is that of the empty string. Repeated rows each get their result; columns with
    the names of FIELDS are replaced; an empty table gives an empty one. Rows stay in their task, nothing is shuffled;
    skip edges join each mention with the one before and the first known one, so they are in proportion to the tokens,
    however often a token recurs.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field.unary, field.chain, field.skip))

    def make():
        own = Field(*shared.value)
        return lambda texts: [list(x) for x in zip(*(scan_text(t.decode("utf-8", "replace"), own) for t in texts), strict=True)]

    return map_text(docs, text_col, make, FIELDS, keep)


def spans_text(found) -> F.Column:
    """All spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
