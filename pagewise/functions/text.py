"""Scripts, directions, marks, numerals, white space and sentences of Arabic and Latin text, as Column functions.

Every function is null for a null text. Lengths and places count code points.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC = r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
HEBREW_SYRIAC = r"֐-׿܀-ݏ߀-ࣿ"
LATIN = r"A-Za-zÀ-ɏ"
MARKS = r"[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭ࣓-ࣿ]"
#: White space as Unicode-aware splitting takes it.
WHITE = r"\t-\r\x1c-\x20\x85\xa0  -     　"
#: The same, one by one, and as a class of Java's that leaves letters after three comparisons.
WHITE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_W = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
_NO_W = f"[^{_W}]"
DIGITS = {"western": "0123456789", "arabic_indic": "٠١٢٣٤٥٦٧٨٩", "eastern": "۰۱۲۳۴۵۶۷۸۹"}
_ALL_DIGITS = "".join(DIGITS.values())


def is_arabic(text: Column) -> Column:
    """Whether the first character is Arabic."""
    return text.rlike(f"^[{ARABIC}]")


def script(text: Column) -> Column:
    """arabic, latin, mixed or neutral."""
    arabic, latin = text.rlike(f"[{ARABIC}]"), text.rlike(f"[{LATIN}]")
    return F.when(arabic & latin, "mixed").when(arabic, "arabic").when(latin, "latin").when(text.isNotNull(), "neutral")


def strong_direction(text: Column) -> Column:
    """rtl or ltr by the first strong character, null if there is none."""
    first = F.regexp_extract(text, f"[{ARABIC}{HEBREW_SYRIAC}{LATIN}]", 0)
    return F.when(first.rlike(f"[{ARABIC}{HEBREW_SYRIAC}]"), "rtl").when(first != "", "ltr")


def direction(text: Column) -> Column:
    return F.when(text.isNotNull(), F.coalesce(strong_direction(text), F.lit("ltr")))


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def strip_tatweel(text: Column) -> Column:
    return F.translate(text, "ـ", "")


def unify_alef(text: Column) -> Column:
    return F.translate(text, "أإآٱ", "اااا")


def unify_ya(text: Column) -> Column:
    return F.translate(text, "ى", "ي")


def unify_ta_marbuta(text: Column) -> Column:
    return F.translate(text, "ة", "ه")


def numerals(text: Column, system: str) -> Column:
    """All digits in one system: western, arabic_indic, eastern, or keep."""
    if system == "keep":
        return text
    if system not in DIGITS:
        raise ValueError(f"unknown numeral system {system!r}; one of keep, {', '.join(DIGITS)}")
    return F.translate(text, _ALL_DIGITS, DIGITS[system] * 3)


def strip_white(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_CHARS))


def collapse_white(text: Column, keep_line_breaks: bool = False) -> Column:
    """Runs of white space become one space; with line breaks kept, lines are stripped and empty ones dropped."""
    if not keep_line_breaks:
        return strip_white(F.regexp_replace(text, f"{_W}+", " "))
    inner = WHITE.replace(r"\t-\r", r"\t\x0b-\r")
    parts = F.transform(F.split(F.regexp_replace(text, f"[{inner}]+", " "), "\n", -1), strip_white)
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def count_marks(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MARKS))


def mark_ratio(text: Column) -> Column:
    """Marks for each character that is none; 0 without such characters."""
    marks = count_marks(text)
    return F.coalesce(marks / F.nullif(F.char_length(text) - marks, F.lit(0)), F.when(text.isNotNull(), F.lit(0.0)))


def vocalisation(text: Column) -> Column:
    """none, partial or full, by the ratio of marks."""
    ratio = mark_ratio(text)
    return F.when(ratio <= 0.01, "none").when(ratio < 0.35, "partial").when(ratio.isNotNull(), "full")


#: Texts that are Python objects at once, and their bytes; one at least.
FORMED_ROWS, FORMED_BYTES = 256, 1 << 20


def _formed(texts: pa.Array, form: str) -> pa.Array:
    wide = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)  # ASCII is in every form
    given = texts.filter(wide).to_pylist()
    if all(unicodedata.is_normalized(form, x) for x in given):
        return texts
    return pc.replace_with_mask(texts, wide, pa.array([unicodedata.normalize(form, x) for x in given], texts.type))


def _in_form(form: str):
    def run(texts: pa.Array) -> pa.Array:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts).cast("int64"), 0)).to_numpy(zero_copy_only=False)
        out, start = [], 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = min(start + FORMED_ROWS, max(start + 1, int(ends.searchsorted(before + FORMED_BYTES, side="right"))), len(texts))
            out.append(_formed(texts.slice(start, stop - start), form))
            start = stop
        return pa.concat_arrays(out) if len(out) > 1 else out[0] if out else texts

    return F.arrow_udf(run, "string")


def unicode_form(text: Column, form: str | None = "NFC") -> Column:
    """A Unicode normal form, in an Arrow function: Spark has none."""
    return text if form is None else _in_form(form)(text)


@dataclass(frozen=True)
class TextPolicy:
    """What ``normalize`` does, in this order."""

    form: str | None = "NFC"
    strip_marks: bool = False
    strip_tatweel: bool = False
    unify_alef: bool = False
    unify_ya: bool = False
    unify_ta_marbuta: bool = False
    numerals: str = "keep"
    collapse_white: bool = True
    keep_line_breaks: bool = False


def normalize(text: Column, policy: TextPolicy = TextPolicy()) -> Column:
    """Applies a policy; twice is the same as once."""
    out = unicode_form(text, policy.form)
    for wanted, step in ((policy.strip_marks, strip_marks), (policy.strip_tatweel, strip_tatweel), (policy.unify_alef, unify_alef), (policy.unify_ya, unify_ya), (policy.unify_ta_marbuta, unify_ta_marbuta)):
        out = step(out) if wanted else out
    out = numerals(out, policy.numerals)
    return collapse_white(out, policy.keep_line_breaks) if policy.collapse_white else out


def tokens(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, f"{_W}+", -1), lambda x: x != "")


def has_tokens(text: Column, least: int) -> Column:
    """Whether there are so many tokens at least; the text is read no further than that."""
    return text.rlike(f"^{_W}*+(?:{_NO_W}++{_W}++){{{least - 1}}}{_NO_W}") if least > 0 else text.isNotNull()


def sentences(text: Column, least_words: int = 3) -> Column:
    """Pieces up to a full stop, mark or line break, stripped, of so many words at least."""
    # a split reads the text once; to extract all matches copies it for each of them
    pieces = F.filter(F.split(text, r"(?<=[.!?؟۔،\n])", -1), lambda s: s != "")
    return F.filter(F.transform(pieces, strip_white), lambda s: has_tokens(s, least_words))


def escape_markup(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def alphabet(text: Column) -> Column:
    """The different characters of a text, ascending."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(text, "", -1))), "")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of some values: the same for the same values, whatever the partitions."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def strip_marks_partly(text: Column, keep: Column | float, seed: Column) -> Column:
    """Each mark stays with probability ``keep``; nothing else changes."""
    keep = F.lit(keep) if isinstance(keep, (int, float)) else keep
    chars = F.split(text, "", -1)
    # most characters are told from marks by their place; the pattern is for the rest
    plain = lambda c: (c < "\u0610") | ((c > "\u061a") & (c < "\u064b")) | ~c.rlike(MARKS)
    stays = F.filter(chars, lambda c, i: plain(c) | (uniform(seed, i) < keep))
    return F.when((keep >= 1) | ~text.rlike(MARKS), text).when(keep <= 0, strip_marks(text)).otherwise(F.array_join(stays, ""))


@dataclass(frozen=True)
class MarkPolicy:
    """What happens to the marks of a document: ``keep``, ``strip``, ``partial`` (a share drawn from a range) or ``mixed`` (one of these by weight)."""

    mode: str = "keep"
    keep_range: tuple[float, float] = (0.1, 0.6)
    mixed_weights: tuple[float, float, float] = (0.15, 0.25, 0.60)

    def __post_init__(self):
        if self.mode not in ("keep", "strip", "partial", "mixed"):
            raise ValueError(f"unknown mode {self.mode!r}; one of keep, mixed, partial, strip")


def kept_share(policy: MarkPolicy, seed: Column) -> Column:
    """The share of marks that a document keeps, drawn once from its seed."""
    low, high = sorted(policy.keep_range)
    partly = F.lit(low) + uniform(seed, F.lit("marks")) * (high - low)
    if policy.mode != "mixed":
        return {"keep": F.lit(1.0), "strip": F.lit(0.0), "partial": partly}[policy.mode]
    full, some, none = policy.mixed_weights
    u = uniform(seed, F.lit("mark-mode")) * (full + some + none)
    return F.when(u < full, 1.0).when(u < full + some, partly).otherwise(0.0)


def apply_marks(text: Column, policy: MarkPolicy, seed: Column) -> Column:
    """``text`` under a policy and ``kept``, the share of marks that stays; 1 for a text without marks. A null text is null."""
    has, share = count_marks(text) > 0, kept_share(policy, seed)
    made = strip_marks(text) if policy.mode == "strip" else text if policy.mode == "keep" else strip_marks_partly(text, share, seed)
    return F.struct(F.when(has, made).otherwise(text).alias("text"), F.when(has, share).otherwise(1.0).alias("kept"))


_HANDS = ("hand", "script", "ruqaa", "ruqa", "thuluth", "diwan", "nastaliq", "shekari", "marhey", "lalezar", "gulzar", "qahiri", "reem", "kufi")


def is_handwriting(file_name: Column) -> Column:
    """Whether the name of a font file hints at a hand."""
    return F.lower(file_name).rlike("|".join(_HANDS))


def font_family(file_name: Column) -> Column:
    """The stem of a font file up to a bracket, hyphen or underscore."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[^.]*$", "")
    return F.regexp_extract(stem, r"^[^\[\-_]*", 0)


_WEIGHTS = ("thin", "extralight", "light", "regular", "medium", "semibold", "bold", "extrabold", "black")


def weight_rank(file_name: Column) -> Column:
    """The rank of the first weight whose name a font file holds, in that order; regular where there is none."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[A-Za-z0-9]*$", "")
    name, out = F.regexp_replace(F.lower(stem), "[-_ ]", ""), F.lit(_WEIGHTS.index("regular"))
    for rank in reversed(range(len(_WEIGHTS))):
        out = F.when(F.contains(name, F.lit(_WEIGHTS[rank])), rank).otherwise(out)
    return out
