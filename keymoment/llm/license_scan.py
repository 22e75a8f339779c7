"""License scan: exact phrases, and short notices found within a bounded number of edits.

A notice of length n that may hold k edits is cut into k + 1 pieces: whatever the edits, one piece stands in the text
unchanged (pigeonhole). One automaton finds all pieces of all notices in a single pass over the text; around each hit
the regex library's bounded-error matching confirms the notice and counts its edits. A window around a hit is as long as
the notice and its edits, so the work is in proportion to the hits, however many stand next to each other. Of matches of
one notice that overlap, those with fewer edits count.

Words are matched as bytes, so a change of a character outside ASCII counts as one edit for each of its bytes.
"""

from __future__ import annotations

import re
from bisect import bisect
from functools import cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from keymoment.llm.common import map_text

# Phrases whose consecutive words give a base label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Short notices as parts with the edits that each part may hold, and the label of the whole.
NOTICES = (
    ((("licensed under the ", 2), ("gnu", 0), (" general public license", 2)), "gpl"),
    ((("gnu ", 0), ("lesser general public license", 3)), "lgpl"),
    ((("gnu ", 0), ("affero general public license", 3)), "agpl"),
    ((("licensed under the ", 2), ("apache", 1), (" license version", 2)), "apache"),
    ((("released under the ", 2), ("mit", 0), (" license", 1)), "mit"),
    ((("permission is hereby granted free of charge to any person obtaining a copy of this software", 6),), "mit"),
    ((("redistribution and use in source and binary forms with or without modification are permitted", 6),), "bsd"),
    ((("mozilla public license", 2),), "mpl"),
    ((("licensed under ", 2), ("cc by nc", 0)), "cc-by-nc"),
    ((("licensed under ", 2), ("cc by sa", 0)), "cc-by-sa"),
    ((("creative commons attribution", 3),), "cc-by"),
    ((("all rights reserved", 2),), "all-rights-reserved"),
)

#: Every ASCII character but digits and small letters separates words; bytes of other characters belong to words.
SEPARATE = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

FIELDS = [
    ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double"),
    ("n_notices", "bigint"), ("spans", "array<struct<label:string,start:int,end:int,edits:int>>"),
]


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; bytes keep their places."""
    return text.lower().translate(SEPARATE).split()


@cache
def _notices() -> tuple[list, ahocorasick.Automaton]:
    notices, pieces = [], {}
    for n, (parts, label) in enumerate(NOTICES):
        text, k = "".join(p for p, _ in parts), sum(e for _, e in parts)
        pattern = "".join(f"(?:{re.escape(p)}){{e<={e}}}" if e else re.escape(p) for p, e in parts)
        notices.append((len(text), k, regex.compile(f"(?b)(?:{pattern})"), label))
        cuts = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            pieces.setdefault(text[a:b], []).append((n, a))
    seeds = ahocorasick.Automaton()
    for piece, uses in pieces.items():
        seeds.add_word(piece, (len(piece), uses))
    seeds.make_automaton()
    return notices, seeds


def find_notices(joined: str) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of the notices in words joined by blanks."""
    notices, seeds = _notices()
    # Hits that agree on where a notice may begin, give or take its edits, have one window.
    windows: dict[int, dict[int, int]] = {}
    for end, (size, uses) in seeds.iter(joined):
        for n, offset in uses:
            start = end + 1 - size - offset
            own, step = windows.setdefault(n, {}), notices[n][1] + 1
            own[start // step] = start
    found = []
    for n, own in windows.items():
        length, k, pattern, label = notices[n]
        hits = set()
        for start in own.values():
            # Beside the best match of a window, what lies before it and behind it is searched.
            left = [(max(0, start - 2 * k), min(len(joined), start + length + 2 * k))]
            while left:
                a, b = left.pop()
                if b - a >= length - k and (m := pattern.search(joined, a, b)):
                    hits.add((sum(m.fuzzy_counts), m.start(), m.end()))
                    left += [(a, m.start()), (m.end(), b)]
        kept: list[tuple[int, int]] = []
        for edits, a, b in sorted(hits):
            at = bisect(kept, (a, b))
            if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
                kept.insert(at, (a, b))
                found.append((label, a, b, edits))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def scan_text(text: bytes) -> tuple:
    flat = text.lower().translate(SEPARATE)
    words = flat.split()
    joined = b" %b " % b" ".join(words)
    places, base = [], set()
    for phrase, label in PHRASES:
        key, at = b" %b " % phrase.encode(), -1
        while (at := joined.find(key, at + 1)) >= 0:
            places.append(at)
            base.add(label)
    if not words:
        return 0, 0, None, None, "", "", 0.0, 0, []
    first, last = (joined.count(b" ", 0, f(places)) for f in (min, max)) if places else (None, None)
    plain = joined.decode("latin-1")
    hits = find_notices(plain)
    score = 1.0 if base else max((1 - e / (b - a) for _, a, b, e in hits), default=0.0)
    spans = []
    if hits:
        # Where each word begins in joined, and where it lies in the text, in code points.
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes + 1) - sizes
        solid = np.frombuffer(flat, np.uint8) != 32
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        for label, a, b, e in hits:
            i = max(0, int(np.searchsorted(begins, a + (plain[a] == " "), side="right")) - 1)
            j = max(i, int(np.searchsorted(begins, b - 1 - (plain[b - 1] == " "), side="right")) - 1)
            spans.append({"label": label, "start": int(points[edge[2 * i]]), "end": int(points[edge[2 * j + 1]]), "edits": e})
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | {h[0] for h in hits})), score, len(hits), spans


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the license columns of FIELDS to each row.

    n_words counts words; n_base, first_word and last_word the places of base phrases (null without one); labels adds
    those of fuzzy notices; score is 1 with a base phrase, else the best notice's share of unchanged characters, else 0.
    spans are code points of the original text. A null or empty text has no words, no labels and score 0. Repeated rows
    each get their result; columns of df with the same names as FIELDS are replaced; an empty table gives an empty one.
    No row leaves its task, so there is no shuffle, whatever the sizes of sources or groups.
    """

    def make():
        return lambda texts: [list(x) for x in zip(*map(scan_text, texts), strict=True)]

    return map_text(docs, text_col, make, FIELDS, keep)
