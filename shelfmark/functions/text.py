"""Text normal form, tokens, path helpers and scalar-or-list coercion.

The normal form works character by character: compatibility decomposition, removal of combining
marks, case folding. That makes it a lookup, so the whole function stays in JVM expressions:

* ASCII text takes ``lower``;
* text made of one-to-one (or one-to-nothing) characters takes ``translate``;
* only text holding a one-to-many character (ligatures, sharp s, Hangul ...) is split into
  characters.

The tables are generated from the Unicode database that ships with Python.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3
_SEP = "\x1f"
_BEYOND_ASCII = r"(?=[^\x00-\x7F])"  # tested first, so that ASCII never reaches a long class


def _folded(ch: str) -> str:
    parts = unicodedata.normalize("NFKD", ch)
    return "".join(p for p in parts if unicodedata.combining(p) == 0).casefold()


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[str, str]]:
    """(translate source, translate target, one-to-many map) without Hangul syllables."""
    single, dropped, many = [], [], {}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or _HANGUL_FIRST <= cp <= _HANGUL_LAST:
            continue
        ch = chr(cp)
        to = " " if ch.isspace() else _folded(ch)
        if to == ch:
            continue
        if len(to) == 1:
            single.append((ch, to))
        elif not to:
            dropped.append(ch)
        else:
            many[ch] = to
    # translate drops the source characters that have no counterpart in the shorter target
    source = "".join(s for s, _ in single) + "".join(dropped)
    return source, "".join(t for _, t in single), many


def _char_class(code_points: list[int]) -> str:
    """Regex character class of the given code points, runs merged to ranges."""
    runs: list[list[int]] = []
    for cp in sorted(code_points):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])

    def shown(cp: int) -> str:
        return chr(cp) if cp > 0x3000 else f"\\x{{{cp:X}}}"

    return "[" + "".join(shown(a) if a == b else f"{shown(a)}-{shown(b)}" for a, b in runs) + "]"


@functools.lru_cache(maxsize=1)
def _expanding_class() -> str:
    points = [ord(c) for c in _tables()[2]] + list(range(_HANGUL_FIRST, _HANGUL_LAST + 1))
    return _BEYOND_ASCII + _char_class(points)


@functools.lru_cache(maxsize=1)
def _maybe_expanding() -> str:
    """A cheap test that never misses: ranges with small gaps between them are taken as one."""
    points = sorted([ord(c) for c in _tables()[2]] + [_HANGUL_FIRST, _HANGUL_LAST])
    wide = set()
    for left, right in zip(points, points[1:], strict=False):
        wide.update(range(left, right + 1) if right - left <= 64 else (left, right))
    wide.update(range(_HANGUL_FIRST, _HANGUL_LAST + 1))
    return _BEYOND_ASCII + _char_class(sorted(wide))


_ASCII_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"  # but the space itself
_SPACES = "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isspace())


def collapse_spaces(c: Column) -> Column:
    """Runs of Unicode whitespace become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, _char_class([ord(ch) for ch in _SPACES]) + "+", " "))


def strip(c: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(_SPACES))


def _jamo(x: Column) -> Column:
    """Leading, vowel and trailing letters of one Hangul syllable (the standard arithmetic)."""
    lead = F.lit("".join(chr(0x1100 + i) for i in range(19)))
    vowel = F.lit("".join(chr(0x1161 + i) for i in range(21)))
    tail = F.lit("".join(chr(0x11A8 + i) for i in range(27)))
    idx = F.ascii(x) - _HANGUL_FIRST
    t = idx % 28
    return F.concat(
        F.substr(lead, (F.floor(idx / 588) + 1).cast("int"), F.lit(1)),
        F.substr(vowel, (F.floor((idx % 588) / 28) + 1).cast("int"), F.lit(1)),
        F.when(t > 0, F.substr(tail, t, F.lit(1))).otherwise(F.lit("")),
    )


def _expansion(x: Column) -> Column:
    many = _tables()[2]
    values = F.split(F.lit(_SEP.join(many.values())), _SEP)
    other = F.try_element_at(values, F.position(x, F.lit("".join(many))))
    return F.when(x.between(chr(_HANGUL_FIRST), chr(_HANGUL_LAST)), _jamo(x)).otherwise(other)


def _expand(c: Column) -> Column:
    """Every one-to-many character of the text replaced by its expansion.

    Most texts hold few different ones, each replaced in a pass; Korean ones hold hundreds and go by character.
    """
    by_character = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.when(ch.rlike(_expanding_class()), _expansion(ch)).otherwise(ch)), ""
    )
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({_expanding_class()})"), F.lit(1)))
    by_kind = F.aggregate(found, c, lambda text, ch: F.replace(text, ch, _expansion(ch)))
    return F.when(c.rlike(f"[{chr(_HANGUL_FIRST)}-{chr(_HANGUL_LAST)}]"), by_character).otherwise(by_kind)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with the value computed and shown once in the plan, however often the
    body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_text(c: Column) -> Column:
    """Comparable form of a text; null becomes the empty string."""
    source, target, _ = _tables()

    def unfold(x: Column) -> Column:
        return F.when(x.rlike(_maybe_expanding()), _expand(x)).otherwise(x)

    def folded(x: Column) -> Column:
        plain = F.translate(F.lower(x), _ASCII_SPACES, " " * len(_ASCII_SPACES))
        rich = bind(F.translate(x, source, target), unfold)
        # every match is copied by itself, so single spaces are none
        return F.regexp_replace(F.when(x.rlike(r"[^\x00-\x7F]"), rich).otherwise(plain), " {2,}", " ")

    return F.trim(bind(F.coalesce(c, F.lit("")), folded))


def tokens(c: Column) -> Column:
    """All word tokens in order (letters, numbers, underscore)."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), 0)  # a group of its own would be tracked for each match


def distinct_tokens(c: Column) -> Column:
    """Tokens, first occurrence kept, order kept."""
    return F.array_distinct(tokens(c))


def non_blank(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def as_list(v: Column) -> Column:
    """A VARIANT holding a scalar or a list becomes a list of trimmed non-blank strings."""
    many = F.try_variant_get(v, "$", "array<string>")
    one = F.array(F.try_variant_get(v, "$", "string"))
    items = F.transform(F.coalesce(many, one), lambda x: strip(x))
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def as_text(v: Column) -> Column:
    """First non-blank entry of a scalar-or-list VARIANT, null when there is none."""
    return F.try_element_at(as_list(v), F.lit(1))


def base_name(path: Column) -> Column:
    """Last component of a slash-separated path, trailing slashes ignored."""
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


_SUFFIX = r"^.+(\.[^.]+)$"


def path_suffix(path: Column) -> Column:
    """Last extension of the last component with its dot, or ''; dot-files have none."""
    return F.regexp_extract(base_name(path), _SUFFIX, 1)


def title_from_path(path: Column) -> Column:
    """File stem with every run of non-word characters turned into one space."""
    name = base_name(path)
    stem = F.when(name.rlike(_SUFFIX), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)
    return F.trim(F.regexp_replace(stem, r"[^\p{L}\p{N}]+", " "))


def safe_long(c: Column) -> Column:
    """Integer or null."""
    return strip(c).try_cast("long")


def strip_nul(c: Column) -> Column:
    """Text without NUL characters."""
    return F.replace(c, F.lit("\x00"), F.lit(""))


