"""Properties of code points as arrays, filled in as code points are met."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

from . import tables as T

# Bits of a code point's properties.
(PRINTABLE, ALPHA, UPPER, LOWER, SPACE, DIGIT, ASCII, PUNCTUATION, SYMBOL, SEPARATOR, EMOTICON, SAFE, COMMON, LATIN, ACCENT, CJK, HANGUL, KATAKANA, HIRAGANA, THAI, ARABIC, ISOLATED, HALFWIDTH, LIGATURE, SUPERSCRIPT, OPENING, UNPRINTABLE, CASED) = (
    1 << i for i in range(28)
)
GLYPH = CJK | HANGUL | KATAKANA | HIRAGANA | THAI
_KNOWN = 1 << 31
_NAMED = ((LATIN, "LATIN"), (CJK, "CJK"), (HANGUL, "HANGUL"), (KATAKANA, "KATAKANA"), (HIRAGANA, "HIRAGANA"), (THAI, "THAI"), (ARABIC, "ARABIC"), (LIGATURE, "LIGATURE"), (SUPERSCRIPT, "SUPERSCRIPT"))

_bits = np.zeros(0x110000, np.uint32)
_base = np.zeros(0x110000, np.int32)


@cache
def name_flags(character: str) -> int:
    """What the character's Unicode name says. Of ASCII, letters are Latin and the rest nothing."""
    if character.isascii():
        return LATIN if character.isalpha() else 0
    name = unicodedata.name(character, "")
    out = sum(bit for bit, word in _NAMED if word in name)
    if out & KATAKANA and "HALFWIDTH" in name:
        out |= HALFWIDTH
    if out & ARABIC and "ISOLATED FORM" in name:
        out |= ISOLATED
    if name.endswith("LETTER AE"):
        out |= LIGATURE
    if name in ("INVERTED QUESTION MARK", "INVERTED EXCLAMATION MARK"):
        out |= OPENING
    if any(x in name for x in T.ACCENTS):
        out |= ACCENT
    return out


def _flagged(bit: int, kind: str) -> Callable[[str], bool]:
    def test(character: str) -> bool:
        return bool(name_flags(character) & bit)

    test.__name__ = test.__qualname__ = f"is_{kind}"
    test.__doc__ = f"Whether the character is {kind.replace('_', ' ')} by its Unicode name."
    return test


is_accentuated, is_latin, is_cjk, is_hangul, is_katakana, is_hiragana, is_thai, is_arabic, is_arabic_isolated_form = (
    _flagged(bit, kind)
    for bit, kind in ((ACCENT, "accentuated"), (LATIN, "latin"), (CJK, "cjk"), (HANGUL, "hangul"), (KATAKANA, "katakana"), (HIRAGANA, "hiragana"), (THAI, "thai"), (ARABIC, "arabic"), (ISOLATED, "arabic_isolated_form"))
)


def remove_accent(character: str) -> str:
    """The head of the character's canonical decomposition, itself if it has none."""
    parts = unicodedata.decomposition(character).split()
    return chr(int(parts[0], 16)) if parts and not parts[0].startswith("<") else character


def is_punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] == "P" or "Punctuation" in (T.unicode_range(c) or "")


def is_symbol(c: str) -> bool:
    category = unicodedata.category(c)
    return category[0] in "SN" or "Forms" in (T.unicode_range(c) or "") and category != "Lo"


def is_emoticon(c: str) -> bool:
    name = T.unicode_range(c) or ""
    return "Emoticons" in name or "Pictographs" in name


def is_separator(c: str) -> bool:
    category = unicodedata.category(c)
    return c.isspace() or c in "｜+<>" or category[0] == "Z" or category in ("Po", "Pd", "Pc")


def is_case_variable(c: str) -> bool:
    return c.islower() != c.isupper()


def is_unprintable(c: str) -> bool:
    return not c.isspace() and not c.isprintable() and c not in "\x1a﻿"


def is_cjk_uncommon(c: str) -> bool:
    return c not in T.common_ideographs()


def _one(codepoint: int) -> int:
    c = chr(codepoint)
    flags = name_flags(c)
    printable, category = c.isprintable(), unicodedata.category(c)
    range_name = T.unicode_range(c) or ""
    noisy = category[0] == "S" or codepoint >= 128 and (category[0] == "N" or "Forms" in range_name and category != "Lo")
    tests = (
        (PRINTABLE, printable),
        (ALPHA, c.isalpha()),
        (UPPER, c.isupper()),
        (LOWER, c.islower()),
        (SPACE, c.isspace()),
        (DIGIT, c.isdigit()),
        (ASCII, codepoint < 128),
        (PUNCTUATION, printable and is_punctuation(c)),
        (SYMBOL, printable and noisy),
        (SEPARATOR, is_separator(c)),
        (EMOTICON, not c.isalpha() and is_emoticon(c)),
        (SAFE, c in T.SAFE_ASCII),
        (COMMON, bool(flags & CJK) and c in T.common_ideographs()),
        (UNPRINTABLE, is_unprintable(c)),
        (CASED, is_case_variable(c)),
    )
    return flags | sum(bit for bit, holds in tests if holds)


def properties(codes: np.ndarray) -> np.ndarray:
    """The property bits of each code point."""
    out = _bits[codes]
    if not out.all():
        for c in np.unique(codes[out == 0]).tolist():
            _bits[c] = _one(c) | _KNOWN
            _base[c] = ord(remove_accent(chr(c)))
        out = _bits[codes]
    return out


def bases(codes: np.ndarray) -> np.ndarray:
    """Each code point without its accent; call after :func:`properties`."""
    return _base[codes]


@cache
def _range_table() -> np.ndarray:
    names, edges = T.ranges()
    found = edges[np.searchsorted(edges[:, 0], np.arange(0x110000), "right") - 1, 1]
    return np.where(found < 0, len(names), found).astype(np.int16)


def range_indexes(codes: np.ndarray) -> np.ndarray:
    """The index of each code point's range; the number of ranges where it is in none."""
    return _range_table()[codes]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
