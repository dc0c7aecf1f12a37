"""Noise of decoded text: ten detectors, each a ratio; their sum is the mess ratio.

All detectors are counts over the text up to some character, so they are written as cumulative sums: those that look
at neighbours compare an array with itself shifted, those that work on words or letter runs sum over the stretch that
ends at a character. The text is read in blocks, and the first block end at which the sum reaches the limit decides.
Many texts are looked at together, one after the other in the same arrays.
"""

from __future__ import annotations

import numpy as np

from . import characters as C
from . import tables as T

NAMES = ("TooManySymbolOrPunctuation", "TooManyAccentuated", "Unprintable", "SuspiciousDuplicateAccent", "SuspiciousRange", "SuperWeirdWord", "CjkUncommon", "SuspiciousKatakana", "ArchaicUpperLower", "ArabicIsolatedForm")
#: Symbols that may stand inside a word.
_IN_WORDS = np.zeros(0x110000, bool)
_IN_WORDS[[ord(x) for x in "<>-=~|_"]] = True


def _upto(x: np.ndarray) -> np.ndarray:
    """Sums over the first 0, 1, ... entries."""
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


class _Texts:
    """Texts one after the other, each with a closing newline, as code points ``codes`` with properties ``p``. ``of`` is
    the text that a character is in, ``first`` where each begins, and the end. Sums are read at ``stops``, numbers of
    characters of all texts; ``base`` is where a stop's text begins."""

    def __init__(self, texts: list[str], steps: list[int]):
        self.codes = C.codes_of("\n".join(texts) + "\n")
        self.p = C.properties(self.codes)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = _upto(length + 1)
        step = np.array(steps)
        count = -(-length // step) + 1
        self.ends = np.cumsum(count) - 1  # each text's last stop
        self.text = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(self.text)) - (self.ends - count + 1)[self.text] + 1
        self.read = np.minimum(place * step[self.text], length[self.text])
        self.read[self.ends] = length + 1
        self.base = self.first[self.text]
        self.stops = self.base + self.read

    def of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def apart(self, at: np.ndarray) -> np.ndarray:
        """Of ascending places, whether each but the first is in another text than the one before."""
        text = self.of(at)
        return text[1:] != text[:-1]

    def sums(self, test: np.ndarray) -> np.ndarray:
        every = _upto(test)
        return every[self.stops] - every[self.base]

    def at(self, indexes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums of whole counts that fall at some characters, in ascending order."""
        if not len(indexes):
            return np.zeros(len(self.stops), np.int64)
        every = _upto(counts)
        return every[np.searchsorted(indexes, self.stops)] - every[np.searchsorted(indexes, self.base)]


def _marks(codes, p, apart):
    """Detector 1: where punctuation counts once and symbols twice, unless safe or a repeat of the printable character
    before."""
    at = np.flatnonzero(p & C.PRINTABLE)
    own, q = codes[at], p[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | apart(at)
    new &= (q & C.SAFE) == 0
    punctuation = (q & C.PUNCTUATION) > 0
    symbol = ~punctuation & ((q & C.DIGIT) == 0) & ((q & C.SYMBOL) > 0) & ((q & C.EMOTICON) == 0)
    return at, new * (punctuation + 2 * symbol)


def mark_weights(codes, p, n):
    """Detector 1's sums over the first 0, 1, ... characters of one text."""
    at, weights = _marks(codes, p, lambda at: False)
    return _upto(np.bincount(at, weights=weights, minlength=n)) if len(at) else np.zeros(n + 1)


def _accent_pairs(t: _Texts):
    """Detector 4: accented Latin letters one after the other, both upper or of one base."""
    at = np.flatnonzero((t.p & (C.ALPHA | C.LATIN)) == C.ALPHA | C.LATIN)
    q = t.p[at]
    both = q[1:] & q[:-1]
    pair = np.flatnonzero(both & C.ACCENT)
    pair = pair[t.of(at[pair]) == t.of(at[pair + 1])]
    here = at[pair + 1]
    base = C.bases(t.codes[at[pair]]) == C.bases(t.codes[here])
    return t.at(here, ((both[pair] & C.UPPER) > 0) + base.astype(int))


def _pairs(codes, p, apart_texts):
    """Detector 5: printable neighbours of ranges that don't go together; spaces and marks part neighbours."""
    at = np.flatnonzero(p & C.PRINTABLE)
    q, r = p[at], C.range_indexes(codes[at])
    apart = (q & (C.SPACE | C.PUNCTUATION | C.SAFE)) > 0
    none = len(T.ranges()[0])
    pair = np.flatnonzero(~apart[1:] & ~apart[:-1] & ((r[1:] != r[:-1]) | (r[:-1] == none)))
    pair = pair[T.suspicious_matrix()[r[pair], r[pair + 1]]]
    return at[pair + 1][~apart_texts(at[pair], at[pair + 1])]


def range_pairs(codes, p, n):
    """Detector 5's sums over the first 0, 1, ... characters of one text."""
    return _upto(np.bincount(_pairs(codes, p, lambda a, b: np.zeros(len(a), bool)), minlength=n))


def _words(t: _Texts, alpha: np.ndarray, met: int):
    """Detector 6: sums over closed words of (words, letters, letters of bad words, long foreign ones, invalid ones).
    Every text ends with an end of a word, so none is in two."""
    codes, p = t.codes, t.p
    ends = ~alpha & ((p & (C.SPACE | C.PUNCTUATION | C.SEPARATOR)) > 0)
    stop = np.flatnonzero(ends)
    start = np.concatenate([[0], stop[:-1] + 1])
    letters = _upto(alpha)
    real = letters[stop] > letters[start]  # words of at least one letter
    start, stop = start[real], stop[real]
    if not len(stop):
        return (np.zeros(len(t.stops), np.int64),) * 5
    where = np.flatnonzero(alpha)
    first = where[letters[start]]
    last = where[letters[stop] - 1]
    none = np.zeros(len(stop), np.int64)
    marks = np.flatnonzero(~alpha & ~ends & ((p & C.SYMBOL) > 0) & ((p & C.DIGIT) == 0) & ~_IN_WORDS[codes]) if met & C.SYMBOL else none[:0]
    inner = np.searchsorted(marks, stop) - np.searchsorted(marks, first) if len(marks) else none

    def count(test: np.ndarray) -> np.ndarray:
        s = _upto(alpha & test)
        return s[stop] - s[start]

    length = letters[stop] - letters[start] + inner
    accents = count((p & C.ACCENT) > 0) if met & C.ACCENT else none
    glyphs = count((p & C.GLYPH) > 0) if met & C.GLYPH else none
    uppers = count((p & C.UPPER) > 0) if met & C.UPPER else none
    foreign = length >= 24
    if foreign.any():
        foreign &= count(((p & C.GLYPH) == 0) & (((p & C.LATIN) == 0) | ((p & C.ACCENT) > 0))) > 0
    not_ascii = count((p & C.ASCII) == 0) > 0
    last_upper = (p[last] & C.UPPER) > 0
    last_accent = (p[last] & C.ACCENT) > 0
    if len(marks):
        last_accent &= np.searchsorted(marks, stop) == np.searchsorted(marks, last)
    first_lower = (p[first] & C.LOWER) > 0
    invalid = (p[stop] & C.OPENING) > 0
    if met & C.SUPERSCRIPT and met & C.LIGATURE:
        invalid |= _raised(p, alpha, first, stop)
    bad = invalid | (inner > 0)
    long = length >= 4
    by_accents = long & (accents / length >= 0.5)
    by_end = long & ~by_accents & last_accent & last_upper & (uppers != length)
    by_glyph = long & ~by_accents & ~by_end & (glyphs == 1)
    by_case = long & ~by_accents & ~by_end & ~by_glyph & not_ascii & first_lower & (uppers == length - 1)
    by_length = foreign & ~((uppers > 0) & (uppers / length <= 0.3))
    bad = bad | by_accents | by_end | by_glyph | by_case | by_length
    far = by_end.astype(int) + by_glyph + by_case + by_length
    return tuple(t.at(stop, x) for x in (np.ones(len(stop), np.int64), length, length * bad, far, invalid))


def _raised(p, alpha, first, stop) -> np.ndarray:
    """Words with a superscript mark (not a letter) after a letter that follows a ligature."""
    out = np.zeros(len(stop), bool)
    raised, joined = _upto((p & C.SUPERSCRIPT) > 0), _upto((p & C.LIGATURE) > 0)
    for i in np.flatnonzero((raised[stop + 1] > raised[first]) & (joined[stop + 1] > joined[first])).tolist():
        last = inside = False
        for k in range(first[i], stop[i] + 1):
            if alpha[k]:
                inside |= last
                last = bool(p[k] & C.LIGATURE)
            elif p[k] & C.SUPERSCRIPT and inside:
                out[i] = True
    return out


def _case_flips(t: _Texts):
    """Detector 9: over runs of cased letters up to 64, twice the pairs of consecutive changes of case."""
    p, n = t.p, len(t.p)
    up, low = (p & C.UPPER) > 0, (p & C.LOWER) > 0
    change = (up[1:] & low[:-1]) | (low[1:] & up[:-1])
    if not (change[1:] & change[:-1]).any():
        return np.zeros(len(t.stops), np.int64)
    other = np.flatnonzero((p & (C.ALPHA | C.CASED)) != C.ALPHA | C.CASED)
    # of neighbouring other characters every second one opens a run itself; the first closes one, unless none is open
    begins = np.zeros(n, bool)
    begins[t.first[:-1]] = True
    new = np.ones(len(other), bool)
    new[1:] = (np.diff(other) > 1) | begins[other[1:]]
    opening = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    order = np.arange(len(other)) - opening[group]
    closes = (order % 2 == 0) != begins[other[opening]][group]
    stop = other[closes]
    if not len(stop):
        return np.zeros(len(t.stops), np.int64)
    start = np.maximum(np.concatenate([[0], stop[:-1] + 1]), t.first[t.of(stop)])
    is_stop = np.zeros(n, bool)
    is_stop[stop] = True
    flip = np.zeros(n, bool)
    flip[1:] = change & ~is_stop[:-1] & ~is_stop[1:]
    # every second of consecutive flips counts
    place = np.flatnonzero(flip)
    fresh = np.ones(len(place), bool)
    fresh[1:] = np.diff(place) > 1
    nth = np.arange(len(place)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    second = place[nth % 2 == 1]
    counted = 2 * (np.searchsorted(second, stop) - np.searchsorted(second, start))
    foreign = _upto(((p & C.ASCII) == 0) & ~is_stop)
    ok = (stop - start <= 64) & ((p[stop] & C.DIGIT) == 0) & (foreign[stop] > foreign[start])
    return t.at(stop, counted * ok)


def _ratios(t: _Texts, pure_ascii: bool) -> np.ndarray:
    """The ten ratios at each stop (the closing newline included in the last of a text). A detector whose characters no
    text has is 0 and not computed."""
    p, sums = t.p, t.sums
    alpha = (p & C.ALPHA) > 0
    met = int(np.bitwise_or.reduce(p))

    def share(a, b, ok=True):
        return np.where((b > 0) & ok, a / np.maximum(b, 1), 0.0)

    out = np.zeros((10, len(t.stops)))
    printable = sums((p & C.PRINTABLE) > 0)
    if met & (C.PUNCTUATION | C.SYMBOL):
        x = share(t.at(*_marks(t.codes, p, t.apart)), printable)
        out[0] = np.where(x >= 0.3, x, 0)
    if met & C.UNPRINTABLE:
        out[2] = np.where(sums(t.codes == 0x1B) > 0, 1.0, 8 * sums((p & C.UNPRINTABLE) > 0) / t.read)
    if not pure_ascii:  # ASCII is one range
        pairs = _pairs(t.codes, p, lambda a, b: t.of(a) != t.of(b))
        out[4] = share(2 * t.at(pairs, np.ones(len(pairs), np.int64)), printable, printable > 13)
    # of ASCII, only a symbol inside a word makes it bad
    marks = ((p & (C.SYMBOL | C.DIGIT | C.PUNCTUATION | C.SEPARATOR | C.SPACE)) == C.SYMBOL) if pure_ascii else alpha
    if marks.any():
        count, length, bad, far, invalid = _words(t, alpha, met)
        out[5] = np.where(invalid > 0, 1.0, np.where((count <= 10) & (far == 0), 0.0, bad / np.maximum(length, 1)))
    if pure_ascii:
        return out
    if met & C.ACCENT:
        every = sums(alpha)
        x = share(sums(alpha & ((p & C.ACCENT) > 0)), every, every >= 8)
        out[1] = np.where(x >= 0.35, x, 0)
        out[3] = share(2 * _accent_pairs(t), sums(alpha & ((p & C.LATIN) > 0)))
    if met & C.CJK:
        ideograph, rare_bits = alpha & ((p & C.CJK) > 0), (p & C.COMMON) == 0
        cjk, rare = sums(ideograph), sums(ideograph & rare_bits)
        out[6] = np.where(cjk >= 4, np.maximum((2 * rare - cjk) / (5 * np.maximum(cjk, 16)), 0), 0)
        if met & C.HALFWIDTH:
            kana_bits = (p & C.KATAKANA) > 0
            kana, half = sums(alpha & kana_bits), sums(alpha & ((p & C.HALFWIDTH) > 0))
            plain, plain_rare = sums(ideograph & ~kana_bits), sums(ideograph & ~kana_bits & rare_bits)
            out[7] = (half >= 4) & (half == kana) & (plain >= 3) & (plain == plain_rare)
    out[8] = _case_flips(t) / np.maximum(t.read, 1)
    if met & C.ISOLATED:
        arabic = sums(alpha & ((p & C.ARABIC) > 0))
        out[9] = share(sums(alpha & ((p & C.ISOLATED) > 0)), arabic, arabic >= 8)
    return out


#: Characters that are looked at in one go; a longer text is one of its own.
AT_ONCE = 1 << 15


def many_details(texts: list[str], maximum: float = 0.2) -> list[tuple[float, list[float]]]:
    """:func:`mess_details` of each text. What a call of numpy costs is paid once for many of them."""
    out: list = [None] * len(texts)
    ascii_ = [x.isascii() for x in texts]
    for pure in (True, False):
        own = [i for i, x in enumerate(ascii_) if x == pure]
        ends = np.cumsum([len(texts[i]) for i in own])
        low = 0
        while low < len(own):
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
            part = own[low:high]
            for i, x in zip(part, _together([texts[i] for i in part], maximum, pure), strict=True):
                out[i] = x
            low = high
    return out


def _together(texts: list[str], maximum: float, pure_ascii: bool) -> list[tuple[float, list[float]]]:
    # the newline after a text closes what is open; only detector 3 counts it as a character
    t = _Texts(texts, [32 if len(x) < 511 else 64 if len(x) < 1024 else 128 for x in texts])
    ratios = _ratios(t, pure_ascii)
    total = np.zeros(len(t.stops))
    for row in ratios:  # one after the other, as sums of floating-point numbers depend on the order
        total = total + row
    over = total >= maximum
    over[t.ends] = True  # reading ends there in any case
    found = np.flatnonzero(over)
    at = found[np.searchsorted(found, np.concatenate([[0], t.ends[:-1] + 1]))]
    return [(round(x, 3), r) for x, r in zip(total[at].tolist(), ratios[:, at].T.tolist(), strict=True)]


def mess_details(text: str, maximum: float = 0.2) -> tuple[float, list[float]]:
    """The mess ratio, and the ten ratios at the place where reading ended."""
    return many_details([text], maximum)[0]


def mess_ratio(text: str, maximum: float = 0.2) -> float:
    """0 for clean text, growing with noise; reading ends where it reaches ``maximum``."""
    return mess_details(text, maximum)[0]
