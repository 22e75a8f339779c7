"""Column functions on text: accents, tokens, answers and query analysis."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# One-letter tokens that are words.
SINGLES = ("a", "y", "ở", "ổ", "ố", "á", "à")
# Words of no weight when answers are compared.
STOP_WORDS = ("màu", "người", "là", "và", "ở", "trong", "có", "con", "cái", "chiếc", "những", "các", "khoảng", "từ", "đến", "vào", "đang", "thì", "được")
# What a question has, and what a sequence of events has.
QUESTION_WORDS = ("bao nhiêu", "là gì", "ở đâu", "ai là", "màu gì", "như thế nào", "tên của", "cuối cùng trên cân")
SEQUENCE_MARKS = ("e1", "e2", "chuỗi hành động", "lần lượt", "thứ tự:", "khoảnh khắc đầu tiên")
# Words of a change of scene.
TRANSITION_WORDS = ("tiếp theo", "ngay sau đó", "sau đó", "đầu tiên", "bắt đầu với", "kết thúc bằng", "rồi", "kế đến", "cuối cùng")
# What a question of numbers or of text on the screen has.
COUNT = "(bao nhiêu|con số|mấy|số lượng|hiển thị|ghi trên)"
# Words between events, and the word of a line that tells one.
EVENT_BREAKS = "(?i)đầu tiên|tiếp theo|sau đó|cuối cùng|kế tiếp"
EVENT_WORD = "khoảnh khắc"
# Signals of text in the picture and of speech, for queries that no model has analysed.
WRITTEN = "(chữ|biển|bảng|logo|banner|áo in|số hiệu|mã|hiệu|mang dòng chữ|\"|')"
SPOKEN = "(nói|phát biểu|hát|thuyết minh|giới thiệu|phỏng vấn|kể về|chia sẻ|bình luận)"
# Whole words that open the gates of text in the picture and of speech.
OCR_WORDS = ("biển số", "bảng hiệu", "dòng chữ", "chữ in", "chữ viết", "tiêu đề", "logo", "banner", "áp phích", "số áo", "tên đường", "tên là", "mang tên", "khắc chữ", "bảng tượng trưng", "áo in", "chữ nổi")
ASR_WORDS = ("hỏi", "nói", "trả lời", "phỏng vấn", "lời thoại", "thuyết minh", "phát biểu", "chia sẻ", "cho biết", "hát", "ca ngợi", "câu thơ")
SPEAKERS = ("người dẫn chương trình", "phóng viên", "nhân vật", "chủ vườn", "bà cụ", "ông cụ")
SPEAKER_VERBS = ("nói", "hỏi", "trả lời", "kể", "cho hay", "đọc")
# Capitalised words that name nothing, and words that aren't searched for in speech.
NO_NAMES = ("tìm", "đoạn", "trong", "trên", "hãy", "video", "clip", "mẩu", "phân", "khi", "có")
NO_SPEECH = ("trong", "khi", "người", "đang", "của", "và", "là", "cho", "vào", "đoạn", "video", "clip")
# Verbs of short actions.
ACTION_VERBS = (
    "rót đổ chế gập gấp phết quết bôi chạm bấm nhấn lướt ném quăng nhảy bật cắt thái thả cầm nắm mở đóng rửa vẽ viết lau chùi nhấc "
    "pour fold spread touch press click swipe throw jump cut slice drop hold open close wash draw"
).split()
#: Where a word begins or ends, in any script.
_EDGE = r"[^\p{L}\p{N}_]"


@cache
def _accents() -> tuple[str, str]:
    """Letters and what is left of them without marks; combining marks come last, as they have nothing left."""
    plain = {chr(c): unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not "̀" <= x <= "ͯ")) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    plain = {k: v for k, v in plain.items() if v != k and len(v) == 1} | {"đ": "d", "Đ": "d"}
    return "".join(plain) + "".join(map(chr, range(0x300, 0x370))), "".join(plain.values())


def strip_accents(text: Column) -> Column:
    """Without accents; a text of ASCII alone is left as it is, which a search tells faster than a translation."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, *_accents())).otherwise(text)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value being computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


#: What words are of, the ASCII letters first, and a whole word with a hyphen: no part of one is tried twice.
_LETTER = r"[a-z0-9_\p{L}\p{M}\p{N}]"
_HYPHEN = r"(?<![a-z0-9])[a-z0-9]++-[a-z0-9]+"


def tokens_dual(text: Column) -> Column:
    """The set of tokens: words of two letters or more, digits, some one-letter words; words with a hyphen also whole and
    joined; each also without accents. Input is taken to be in composed form (NFC)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    whole = F.flatten(F.transform(_found(low, _HYPHEN), lambda w: F.array(w, F.replace(w, F.lit("-"), F.lit("")))))
    # Marks don't bound words, so a text's plain words are its words without accents; those of ASCII alone are there already.
    plain = lambda words: F.filter(F.transform(F.filter(words, lambda w: F.octet_length(w) > F.char_length(w)), lambda w: F.translate(w, *_accents())), lambda w: F.length(w) > 1)
    words = _let(_found(low, f"{_LETTER}{_LETTER}+|[0-9{''.join(SINGLES)}]"), lambda w: F.concat(w, plain(F.array_distinct(w))))
    return F.array_distinct(F.concat(F.when(F.contains(low, F.lit("-")), whole).otherwise(F.array().cast("array<string>")), words))


def tokens_clean(text: Column) -> Column:
    """The list of words, repeats kept."""
    return _found(F.lower(F.coalesce(text, F.lit(""))), f"{_LETTER}+")


def normalize_answer(text: Column) -> Column:
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}_\s]", ""), r"\s+", " ")


def _core_words(answer: Column) -> Column:
    return F.array_except(F.filter(F.split(answer, " "), lambda w: w != ""), F.array(*[F.lit(w) for w in STOP_WORDS]))


def answers_match(truth: Column, said: Column) -> Column:
    """Equal, one within the other, or enough words in common: two, or one if an answer has but one such word."""
    a, b = normalize_answer(truth), normalize_answer(said)
    x, y = _core_words(a), _core_words(b)
    both, least = F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))
    some = (F.length(a) > 0) & (F.length(b) > 0)
    return some & (a.contains(b) | b.contains(a) | ((least > 0) & ((both >= 2) | ((least == 1) & (both == 1)))))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def whole_words(words: tuple[str, ...]) -> str:
    """A pattern of any of the words, not within a longer one; the same in Java's and other dialects."""
    return f"(^|{_EDGE})({'|'.join(words)})($|{_EDGE})"


def task_of(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(_any(low, QUESTION_WORDS), "qa").when(_any(low, SEQUENCE_MARKS), "trake").otherwise("kis")


def is_count(text: Column) -> Column:
    return F.lower(text).rlike(COUNT)


def has_transition(text: Column) -> Column:
    return _any(F.lower(text), TRANSITION_WORDS)


def has_action(text: Column) -> Column:
    return F.arrays_overlap(tokens_clean(text), F.array(*[F.lit(v) for v in ACTION_VERBS]))


def _trimmed(parts: Column, more_than: int) -> Column:
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.char_length(x) > more_than)


#: Explicit events: a line that begins with E1 or Event 1, up to the next one.
EVENT_LINE = r"(?:^|\n)\s*(?:[Ee][0-9]+|[Ee][Vv][Ee][Nn][Tt]\s*[0-9]+)[\s:]+"


def split_events(text: Column) -> Column:
    """The events of E1 or Event 1 lines if there are two or more, else the parts between commas, semicolons and words that
    go on, if two or more, else the text twice."""
    cut = F.regexp_replace(F.concat(F.lit("\n"), text), EVENT_LINE, "\u0001")
    lines = _trimmed(F.slice(F.split(cut, "\u0001"), 2, F.greatest(F.size(F.split(cut, "\u0001")), F.lit(1))), 0)
    go_on = F.regexp_replace(text, f"(?<={_EDGE})(và|tiếp tục|cuối cùng)(?={_EDGE})", ",")
    parts = _trimmed(F.split(go_on, "[,;]"), 0)
    return F.when(F.size(lines) >= 2, lines).when(F.size(parts) >= 2, parts).otherwise(F.array(text, text))


def split_events_at_words(text: Column) -> Column:
    """The variant of sequence search: parts of more than ten characters between E1 marks, semicolons and sequence words, if
    two or more, else the text three times."""
    parts = _trimmed(F.split(text, r"E[0-9]+:|E[0-9]+\s+|;\s*|sau đó|tiếp theo|kế đến"), 10)
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array(text, text, text))


def split_events_of_lines(text: Column) -> Column:
    """The variant of an input form: lines that number an event or step, without the number; else parts of more than eight
    characters between line breaks and semicolons, if two or more; else three placeholders."""
    mark = r"(?i)^((sự kiện|event|bước|e)\s*[0-9]+[:.-]|[0-9]+[.)])\s*"
    lines = _trimmed(F.split(text, "\n"), 0)
    events = _trimmed(F.transform(F.filter(lines, lambda x: x.rlike(mark)), lambda x: F.regexp_replace(x, mark, "")), 0)
    parts = _trimmed(F.split(text, r"[\n;]"), 8)
    return F.when(F.size(events) > 0, events).when(F.size(parts) >= 2, parts).otherwise(F.array(*[F.lit(f"Sự kiện {i}") for i in (1, 2, 3)]))


def cues(text: Column) -> Column:
    """The first four parts between commas, semicolons and full stops, of more than three letters."""
    return F.slice(_trimmed(F.split(text, "[,;.]"), 3), 1, 4)


def decompose(text: Column) -> Column:
    """Cues of a description: parts between commas and the word "và"."""
    return _trimmed(F.split(F.regexp_replace(text, f"(?<={_EDGE})và(?={_EDGE})", ","), "[,;.]"), 0)


def refine(text: Column, task: Column) -> Column:
    """What is known of a query without a model: weights of the three modalities, keywords of text and speech, events.

    Events are the lines that begin with E1 or tell a moment; of a sequence query without any, the parts of more than ten
    characters between sequence words; else the text."""
    low = F.lower(text)
    ocr, asr = low.rlike(WRITTEN), low.rlike(SPOKEN)
    v = F.when(ocr | asr, 0.50).otherwise(0.90)
    o, a = (F.when(x, 0.40).otherwise(0.05) for x in (ocr, asr))
    some = F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.char_length(w) > 3), 1, 5)
    none = F.array().cast("array<string>")
    lines = F.filter(_trimmed(F.split(text, "\n"), 0), lambda x: x.rlike(r"^[eE][0-9]+[:\s\-.]") | F.lower(x).contains(EVENT_WORD))
    parts = _trimmed(F.split(text, EVENT_BREAKS), 10)
    events = F.when(F.size(lines) > 0, lines).when((task == "trake") & (F.size(parts) > 0), parts).otherwise(F.array(text))
    weights = [(x / (v + o + a)).alias(n) for x, n in ((v, "visual"), (o, "ocr"), (a, "asr"))]
    return F.struct(*weights, F.when(ocr, some).otherwise(none).alias("ocr_keywords"), F.when(asr, some).otherwise(none).alias("asr_keywords"), events.alias("events"))


#: Names: capitalised words of three letters or more, and the capitalised ones behind them.
NAMES = r"(?U:\b[A-ZĐ][a-zA-Z0-9\-_]{2,}\b)(?:\s+[A-ZĐ][a-zA-Z0-9\-_]+)*"
QUOTED = r"[\"'“‘]([^\"'”’]+)[\"'”’]"


def gate(text: Column) -> Column:
    """Which modalities a query calls for, by its words: text in the picture if it quotes, names or mentions some; speech if
    it mentions any. With the words to search for, and weights 1.0, 1.5 and 1.2, or 0 where a gate stays shut."""
    low = F.lower(text)
    quoted = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))
    names = F.filter(F.regexp_extract_all(text, F.lit(NAMES), F.lit(0)), lambda x: ~F.lower(x).isin(*NO_NAMES))
    ocr = (F.size(quoted) > 0) | (F.size(names) > 0) | low.rlike(whole_words(OCR_WORDS))
    asr = low.rlike(whole_words(ASR_WORDS)) | low.rlike(f"(^|{_EDGE})({'|'.join(SPEAKERS)})\\s+({'|'.join(SPEAKER_VERBS)})($|{_EDGE})")
    said = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: (F.char_length(w) > 1) & ~F.lower(w).isin(*NO_SPEECH))
    none = F.array().cast("array<string>")
    return F.struct(
        ocr.alias("has_ocr"), F.array_distinct(F.concat(quoted, names)).alias("ocr_keywords"), asr.alias("has_asr"),
        F.when(asr, F.array_distinct(F.slice(said, 1, 8))).otherwise(none).alias("asr_keywords"), (~ocr & ~asr).alias("pure_visual"),
        F.lit(1.0).alias("visual"), F.when(ocr, 1.5).otherwise(0.0).alias("ocr"), F.when(asr, 1.2).otherwise(0.0).alias("asr"),
    )


def salvage_json(text: Column, schema: str) -> Column:
    """A JSON object within code fences or other words."""
    bare = F.regexp_extract(F.regexp_replace(text, "```(json)?", ""), r"(?s)(\{.*\})", 1)
    return F.from_json(bare, schema)


def salvage_prompts(text: Column) -> Column:
    """What a pattern can still read of a broken analysis: up to three visual prompts, the first repeated if there are fewer,
    and the flags; null without prompts."""
    inner = F.regexp_extract(text, r'(?s)"visual_prompts"\s*:\s*\[(.*?)\]', 1)
    found = F.regexp_extract_all(inner, F.lit(r'"([^"\\]*(?:\\.[^"\\]*)*)"'), F.lit(1))
    first = F.try_element_at(found, F.lit(1))
    three = F.slice(F.concat(found, F.array(first, first)), 1, 3)
    flag = lambda name: F.lower(text).contains(f'"{name}": true')
    return F.when(F.size(found) > 0, F.struct(three.alias("visual_prompts"), *[flag(n).alias(n) for n in ("has_ocr_signal", "has_asr_signal", "is_qa", "is_trake")]))
