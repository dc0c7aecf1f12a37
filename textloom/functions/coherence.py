"""Coherence of decoded text with languages: does the order of its letters by frequency agree with a language's?"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from functools import cache, lru_cache

import numpy as np

from . import characters as C
from . import tables as T

Ratios = list[tuple[str, float]]


@cache
def language_features(name: str) -> tuple[bool, bool]:
    """Whether the alphabet has accented letters, and whether it is all Latin. ValueError for an unknown language."""
    if name not in T.LANGUAGES:
        raise ValueError(f"{name} has no frequency profile")
    flags = [C.name_flags(c) for c in T.LANGUAGES[name]]
    return any(f & C.ACCENT for f in flags), all(f & C.LATIN for f in flags)


@cache
def _places(name: str) -> dict[str, int]:
    return {c: i for i, c in enumerate(T.LANGUAGES[name])}


def alphabet_languages(letters: Iterable[str], ignore_non_latin: bool = False) -> list[str]:
    """Languages of which at least a fifth of the alphabet is among the letters, the fullest first."""
    letters = frozenset(letters)
    table, size = _place_table()
    met = [table[c] for c in letters if c in table]
    if not met:
        return []
    has_accents, latin = _features()
    share = (np.array(met) >= 0).sum(axis=0) / size
    fits = share >= 0.2
    if ignore_non_latin:
        fits &= latin
    if any(C.name_flags(c) & C.ACCENT for c in letters):
        fits &= has_accents
    names, found = list(T.LANGUAGES), np.flatnonzero(fits)
    return [names[i] for i in found[np.argsort(-share[found], kind="stable")].tolist()]


@cache
def _features() -> tuple[np.ndarray, np.ndarray]:
    """:func:`language_features` of every language."""
    accents, latin = np.array([language_features(name) for name in T.LANGUAGES]).T
    return accents, latin


def popularity(name: str, ordered: Sequence[str]) -> float:
    """The share of the letters, ordered from most to least frequent, whose place agrees with the language's. NaN
    without letters, ValueError for an unknown language."""
    found = agreeing(name, ordered)
    return found / len(ordered) if ordered else float("nan")


def agreeing(name: str, ordered: Sequence[str]) -> int:
    """How many of the letters, ordered from most to least frequent, have a place that agrees with the language's.

    A shared letter agrees if it is the language's most frequent one; or, in large alphabets, if its place projected to
    the alphabet's size is within a third of it; or if two fifths of the letters before it in the language are before
    it here too, or two fifths of those from it on are here too from it on. In alphabets up to 26 letters, it has to be
    within four places in any case.
    """
    if name not in T.LANGUAGES:
        raise ValueError(f"{name} has no frequency profile")
    if not ordered:
        return 0
    alphabet = T.LANGUAGES[name]
    size, n = len(alphabet), len(ordered)
    place = _places(name)
    shared = [(place[c], i) for i, c in enumerate(ordered) if c in place]
    if not shared:
        return 0
    scale, small = size / n, size <= 26
    certain, open_ = 0, []
    for theirs, ours in shared:
        apart = abs(int(ours * scale) - theirs)
        if small and apart > 4:
            continue
        if theirs == 0 or not small and apart < size / 3:
            certain += 1
        else:
            open_.append((theirs, ours))
    if not open_:
        return certain
    where, place_here = np.array(shared).T
    lower, ours = np.array(open_).T
    before = ((where < lower[:, None]) & (place_here < ours[:, None])).sum(axis=1)
    after = ((where >= lower[:, None]) & (place_here >= ours[:, None])).sum(axis=1)
    return certain + int(np.count_nonzero((5 * before >= 2 * lower) | (5 * after >= 2 * (size - lower))))


@cache
def _place_table() -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of each letter its place in every language, in order of the languages (-1: none); and the alphabets' sizes."""
    table: dict[str, np.ndarray] = {}
    for k, name in enumerate(T.LANGUAGES):
        for c, i in _places(name).items():
            table.setdefault(c, np.full(len(T.LANGUAGES), -1, np.int32))[k] = i
    return table, np.array([len(x) for x in T.LANGUAGES.values()])


@cache
def _numbers() -> dict[str, int]:
    return {name: k for k, name in enumerate(T.LANGUAGES)}


#: Numbers of letters for which languages are compared at once; counts of them fit into a byte.
FEW = 64


def all_agreeing(ordered: Sequence[str], names: Sequence[str] | None = None) -> dict[str, int]:
    """:func:`agreeing` of several languages, of every one if none are named."""
    names, n = list(T.LANGUAGES) if names is None else list(names), len(ordered)
    if not 0 < n <= FEW or len(names) == 1:
        return {name: agreeing(name, ordered) for name in names}
    table, size = _place_table()
    met = [i for i, c in enumerate(ordered) if c in table]
    if not met or not names:
        return dict.fromkeys(names, 0)
    theirs, ours = np.array([table[ordered[i]] for i in met]), np.array(met)[:, None]
    if len(names) < len(size):
        of = [_numbers()[name] for name in names]
        theirs, size = theirs[:, of], size[of]
    return dict(zip(names, _agree(theirs, ours, size, n).tolist(), strict=True))


def _agree(theirs: np.ndarray, ours: np.ndarray, size: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """How many letters agree in each column: ``theirs`` are letters' places in a language (-1: none) of ``size``, a row
    for each of up to FEW letters in the order of ``ours``, their places among ``n``."""
    shared, small = theirs >= 0, size <= 26
    apart = np.abs((ours * (size / n)).astype(np.int64) - theirs)
    open_ = shared & ~(small & (apart > 4))
    sure = open_ & ((theirs == 0) | (~small & (apart < size / 3)))
    # letters by their place here, so those before one are those above it; ones that a language lacks come after all
    place = np.where(shared, theirs, np.iinfo(np.int16).max).astype(np.int16)
    below = (place[None, :, :] < place[:, None, :]).view(np.uint8)
    every = below.sum(axis=1, dtype=np.uint8)
    below &= _earlier(len(theirs))
    before = below.sum(axis=1, dtype=np.uint8)
    following = np.cumsum(shared[::-1], axis=0)[::-1]
    after = following - (every - before)
    theirs = theirs.astype(np.int64)
    agrees = open_ & ~sure & ((5 * before.astype(np.int64) >= 2 * theirs) | (5 * after >= 2 * (size - theirs)))
    return (sure | agrees).sum(axis=0)


@cache
def _earlier(n: int) -> np.ndarray:
    return (np.arange(n)[:, None] > np.arange(n)).astype(np.uint8)[:, :, None]


def layers(text: str) -> list[str]:
    """The letters of the text, lower-cased, by layer: each letter goes to the first layer whose first letter's range
    goes with its own."""
    codes = C.codes_of(text)
    if not len(codes):
        return []
    ranges = C.range_indexes(codes)
    letters = ((C.properties(codes) & C.ALPHA) > 0) & (ranges < len(T.ranges()[0]))
    codes, ranges = codes[letters], ranges[letters]
    suspicious = T.suspicious_matrix()
    founded: list[int] = []
    of: dict[int, int] = {}
    # in order of first appearance, a range's layer is settled when it is met
    for r in dict.fromkeys(ranges.tolist()):
        target = next((i for i, f in enumerate(founded) if not suspicious[f, r]), None)
        if target is None:
            target = len(founded)
            founded.append(r)
        of[r] = target
    if len(founded) == 1:
        return [codes.astype("<u4").tobytes().decode("utf-32-le").lower()]
    table = np.zeros(len(T.ranges()[0]), np.int64)
    for r, target in of.items():
        table[r] = target
    layer = table[ranges]
    return [codes[layer == i].astype("<u4").tobytes().decode("utf-32-le").lower() for i in range(len(founded))]


def ordered_letters(letters: str) -> list[str]:
    """Distinct letters, the most frequent first, of equally frequent ones the first met."""
    return [c for c, _ in Counter(letters).most_common()]


def fold_alternatives(ratios: Ratios) -> Ratios:
    """Profiles of one language (marked by dashes) as that language with the best ratio, if any appears twice."""
    best: dict[str, float] = {}
    for name, ratio in ratios:
        base = name.replace("—", "")
        best[base] = max(best.get(base, ratio), ratio)
    return list(ratios) if len(best) == len(ratios) else list(best.items())


def merge(results: Iterable[Ratios]) -> Ratios:
    """The mean ratio of each language over several texts, the highest first."""
    every: dict[str, list[float]] = {}
    for ratios in results:
        for name, ratio in ratios:
            every.setdefault(name, []).append(ratio)

    def total(values: list[float]) -> float:
        out = values[0]
        for v in values[1:]:
            out += v
        return out

    return sorted(((k, round(total(v) / len(v), 4)) for k, v in every.items()), key=lambda x: -x[1])


@lru_cache(4096)
def _ordered_layers(text: str) -> tuple[list[str], ...]:
    """The letters of layers that are long enough."""
    return tuple(ordered_letters(layer) for layer in layers(text) if len(layer) > 32)


@cache
def _letter_rows() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its row, and in rows a letter's place in every language (-1: none); the last row is of
    letters that no language has."""
    table, _ = _place_table()
    rows = np.full(0x110000, len(table), np.int16)
    rows[[ord(c) for c in table]] = np.arange(len(table))
    return rows, np.array([*table.values(), np.full(len(T.LANGUAGES), -1)], np.int16)


def _alphabets(orders: list[list[str]], latin_only: list[bool]) -> list[list[str]]:
    """:func:`alphabet_languages` of several lists of distinct letters, none empty."""
    codes = C.codes_of("".join(map("".join, orders)))
    first = np.concatenate([[0], np.cumsum([len(x) for x in orders[:-1]])]).astype(np.int64)
    of, places = _letter_rows()
    _, size = _place_table()
    has_accents, latin = _features()
    share = np.add.reduceat(places[of[codes]] >= 0, first, axis=0, dtype=np.int64) / size
    accents = np.logical_or.reduceat((C.properties(codes) & C.ACCENT) > 0, first)
    fits = (share >= 0.2) & (latin | ~np.array(latin_only)[:, None]) & (has_accents | ~accents[:, None])
    order, n, names = np.argsort(np.where(fits, -share, 1), axis=1, kind="stable").tolist(), fits.sum(axis=1).tolist(), list(T.LANGUAGES)
    return [[names[k] for k in row[:m]] for row, m in zip(order, n, strict=True)]


def _agreements(orders: list[list[str]], names: list[list[str]]) -> list[list[int]]:
    """:func:`agreeing` of several lists of letters, up to FEW, with each of their languages: a column for each pair."""
    lengths = np.array([len(x) for x in orders])
    most, (of, places) = int(lengths.max()), _letter_rows()
    rows = np.full((len(orders), most), len(places) - 1, np.int16)
    rows[np.arange(most) < lengths[:, None]] = of[C.codes_of("".join(map("".join, orders)))]
    own = np.repeat(np.arange(len(orders)), [len(x) for x in names])
    of_name = _numbers()
    language = np.array([of_name[x] for k in names for x in k], np.int64)
    size = _place_table()[1][language]
    theirs = np.ascontiguousarray(places[rows[own], language[:, None]].T)
    agrees = _agree(theirs, np.arange(most)[:, None], size, lengths[own]).tolist()
    ends = np.cumsum([len(x) for x in names]).tolist()
    return [agrees[end - len(x) : end] for end, x in zip(ends, names, strict=True)]


#: Lists of letters that are compared in one go.
LISTS = 64
#: Texts remembered, under each threshold and choice of languages.
REMEMBERED = 4096
_known: dict[tuple[str, float, tuple[str, ...]], tuple[tuple[str, float], ...]] = {}


def prepare(requests: Iterable[tuple[str, float, tuple[str, ...]]]) -> None:
    """Remember the languages of texts, each with a threshold and the languages to consider; those not known are looked
    for together."""
    requests = list(dict.fromkeys(requests))
    if len(_known) + len(requests) > REMEMBERED:
        _known.clear()
    new = [r for r in requests if r not in _known]
    layered = [(r, ordered) for r in new for ordered in _ordered_layers(r[0])]
    found: dict[tuple[str, float, tuple[str, ...]], list[tuple[list[str], list[int], int]]] = {r: [] for r in new}
    for low in range(0, len(layered), LISTS):
        part = layered[low : low + LISTS]
        names = [[x for x in r[2] if x != "Latin Based"] for r, _ in part]
        free = [i for i, x in enumerate(names) if not x]
        if free:
            for i, x in zip(free, _alphabets([part[i][1] for i in free], ["Latin Based" in part[i][0][2] for i in free]), strict=True):
                names[i] = x
        few = [i for i, (_, ordered) in enumerate(part) if len(ordered) <= FEW and names[i]]
        agree = dict(zip(few, _agreements([part[i][1] for i in few], [names[i] for i in few]), strict=True)) if few else {}
        for i, (r, ordered) in enumerate(part):
            found[r].append((names[i], agree[i] if i in agree else [agreeing(x, ordered) for x in names[i]], len(ordered)))
    for r, layers_ in found.items():
        out, high = [], 0
        for names_, agrees, n in layers_:
            for name, m in zip(names_, agrees, strict=True):
                ratio = m / n
                if ratio < r[1]:
                    continue
                high += ratio >= 0.8
                out.append((name, round(ratio, 4)))
                if high >= 3:
                    break
        _known[r] = tuple(sorted(fold_alternatives(out), key=lambda x: -x[1]))


def _coherence(text: str, threshold: float, inclusion: tuple[str, ...]) -> tuple[tuple[str, float], ...]:
    request = text, threshold, inclusion
    if request not in _known:
        prepare([request])
    return _known[request]


def forget() -> None:
    """Empty the memory of texts seen before."""
    _known.clear()
    _ordered_layers.cache_clear()


def coherence_ratio(text: str, threshold: float = 0.1, inclusion: str | Sequence[str] | None = None) -> Ratios:
    """Languages the text agrees with, and how well. ``inclusion``: languages to consider, comma-separated or a list."""
    names = inclusion.split(",") if isinstance(inclusion, str) else inclusion or ()
    return list(_coherence(text, threshold, tuple(names)))
