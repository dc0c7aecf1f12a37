"""Detection of the encoding of one payload: candidates in order of likelihood, each decoded in samples, scored, and
accepted or given up. A payload is a value; nothing here knows of Spark."""

from __future__ import annotations

import re
from collections.abc import Generator, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from . import coherence as K
from . import tables as T
from .coherence import Ratios, coherence_ratio, merge
from .mess import NAMES, many_details

_DECLARED_BYTES = re.compile(T.DECLARATION.encode(), re.IGNORECASE)
_DECLARED_TEXT = re.compile(T.DECLARATION, re.IGNORECASE)
_NOT_ASCII = bytes(range(128, 256))
#: How much of a large payload is decoded at first, and from where the rest is checked.
LARGE_PREFIX, LARGE_CHECK = 500_000, 50_000
Noise = tuple[float, list[float]]
#: Asks for the noise of samples, and is sent what holds it; or (samples with threshold and languages) for coherence,
#: which is remembered.
Asking = Generator["list[str] | list[tuple]", dict[str, Noise], "list[Match] | None"]
UNICODE = ("utf_7", "utf_8", "utf_16", "utf_16_be", "utf_16_le", "utf_32", "utf_32_be", "utf_32_le", "utf_8_sig")

#: Noise of samples scored before, by threshold; as many are kept as ``REMEMBERED``.
_scored: dict[float, dict[str, Noise]] = {}
REMEMBERED = 8192


def _scores(samples: Iterable[str], threshold: float) -> dict[str, Noise]:
    """The noise of each sample, those not met before scored together."""
    samples = dict.fromkeys(samples)
    known = _scored.setdefault(threshold, {})
    new = [x for x in samples if x not in known]
    if len(known) + len(new) > REMEMBERED:
        kept = {x: known[x] for x in samples if x in known}
        known.clear()
        known.update(kept)
    known.update(zip(new, many_details(new, threshold), strict=True))
    return known


@dataclass(frozen=True)
class Options:
    """What detection is asked for. ``steps`` samples of ``chunk_size`` bytes are scored; a candidate whose mean noise
    reaches ``threshold`` is given up; languages under ``language_threshold`` don't count. ``only`` and ``without``
    name encodings, by any alias, that alone or not at all are tried; ``preemptive`` believes declarations inside the
    payload; ``fallback`` gives a last resort where nothing fits; ``explain`` fills the trace."""

    steps: int = 5
    chunk_size: int = 512
    threshold: float = 0.2
    language_threshold: float = 0.1
    only: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    preemptive: bool = True
    fallback: bool = True
    explain: bool = False

    def __post_init__(self) -> None:
        if self.steps < 1 or self.chunk_size < 1:
            raise ValueError("steps and chunk_size are at least 1")


@dataclass(eq=False)
class Match:
    """One encoding that the payload may be in. Equal to another one of the same encoding and text, and to every name
    of its encoding."""

    payload: bytes
    encoding: str
    chaos: float
    bom: bool
    languages: Ratios
    declared: str | None
    text: str | None = None
    submatches: list[Match] = field(default_factory=list)

    def decoded(self) -> str:
        if self.text is None:
            text = strict(self.payload, self.encoding)
            self.text = text[1:] if self.encoding == "utf_7" and self.bom and text.startswith("﻿") else text
        return self.text

    def __eq__(self, other: object) -> bool:
        if isinstance(other, str):
            return T.encoding_name(other, strict=False) == self.encoding
        return isinstance(other, Match) and self.same_as(other)

    __hash__ = None

    def __lt__(self, other: object) -> bool:
        if not isinstance(other, Match):
            raise ValueError("only matches are ranked")
        return ranks_before(self, other)

    def same_as(self, other: Match) -> bool:
        return self is other or self.encoding == other.encoding and self.decoded() == other.decoded()

    def add_submatch(self, other: Match) -> None:
        """Attach another encoding of the same text."""
        if not isinstance(other, Match) or self.same_as(other):
            raise ValueError(f"a {type(other).__name__} that is no other match can't be attached")
        other.text = None
        self.submatches.append(other)

    def take_submatches(self) -> list[Match]:
        """Detach them all."""
        taken, self.submatches = self.submatches, []
        return taken

    @property
    def coherence(self) -> float:
        return self.languages[0][1] if self.languages else 0.0

    @property
    def multi_byte_usage(self) -> float:
        return 1.0 - len(self.decoded()) / len(self.payload) if self.payload else 0.0

    @property
    def could_be_from(self) -> list[str]:
        return [self.encoding, *(x.encoding for x in self.submatches)]

    @property
    def language(self) -> str:
        """The best language; without one English for ASCII, or the first that the encoding is for."""
        if self.languages:
            return self.languages[0][0]
        if "ascii" in self.could_be_from:
            return "English"
        of = T.target_languages(self.encoding)
        return "Unknown" if not of or "Latin Based" in of else of[0]

    @property
    def alphabets(self) -> list[str]:
        return sorted({r for r in map(T.unicode_range, set(self.decoded())) if r})

    def output_text(self, target: str = "utf_8") -> str:
        """The text; a declaration of another encoding than UTF-8 in it names ``target`` instead."""
        text = self.decoded()
        if self.declared and self.declared.lower() not in ("utf-8", "utf8", "utf_8"):
            m = _DECLARED_TEXT.search(text[: T.DECLARATION_ZONE])
            if m:
                name = T.encoding_name(target).replace("_", "-")
                text = text[: m.start()] + m[0].replace(m[1], name) + text[m.end() :]
        return text

    def output(self, target: str = "utf_8") -> bytes:
        return self.output_text(target).encode(target, "replace")


def strict(payload: bytes, encoding: str) -> str:
    """Decoded text; UnicodeError for what isn't valid, lone surrogates included."""
    text = payload.decode(encoding)
    if encoding == "utf_7" and any("\ud800" <= c < "" for c in text):
        raise UnicodeDecodeError(encoding, payload, 0, len(payload), "lone surrogate")
    return text


def lenient(payload: bytes, encoding: str) -> str:
    text = payload.decode(encoding, "ignore")
    if encoding == "utf_7" and any("\ud800" <= c < "" for c in text):
        raise UnicodeDecodeError(encoding, payload, 0, len(payload), "lone surrogate")
    return text


def signature(payload: bytes) -> tuple[str | None, bytes]:
    """The encoding that a mark at the beginning stands for, and the mark."""
    return next(((name, mark) for name, mark in T.MARKS if payload.startswith(mark)), (None, b""))


def declared_encoding(payload: bytes, zone: int = T.DECLARATION_ZONE) -> str | None:
    """The first known encoding that the ASCII part of the beginning names."""
    begin = payload[:zone].translate(None, _NOT_ASCII)
    low = begin.lower()
    if b"coding" not in low and b"charset" not in low:
        return None
    for m in _DECLARED_BYTES.finditer(begin):
        name = T.normalize_name(m[1].decode("ascii"))
        if len(name) <= 64 and name in T.names():
            return T.names()[name]
    return None


def ranks_before(a: Match, b: Match) -> bool:
    """Less noise; where that is about equal, more coherence; where that too is, more use of long codes. Not
    transitive, so :func:`ranked` is part of the meaning."""
    if abs(a.chaos - b.chaos) < 0.005:
        if abs(a.coherence - b.coherence) > 0.02:
            return a.coherence > b.coherence
        if len(a.payload) < T.TOO_BIG:
            return a.multi_byte_usage > b.multi_byte_usage
    return a.chaos < b.chaos


def ranked(matches: list[Match]) -> list[Match]:
    """Insertion sort by binary search, which starts from the run at the beginning: lists under 64 take a falling run
    the other way round, longer ones are inserted from the second on."""
    out, rest = matches[:1], matches[1:]
    if 2 <= len(matches) < 64:
        falling = ranks_before(matches[1], matches[0])
        n = 2
        while n < len(matches) and ranks_before(matches[n], matches[n - 1]) == falling:
            n += 1
        out, rest = (matches[:n][::-1] if falling else matches[:n]), matches[n:]
    for item in rest:
        low, high = 0, len(out)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if ranks_before(item, out[mid]) else (mid + 1, high)
        out.insert(low, item)
    return out


def fold(matches: list[Match], item: Match) -> None:
    """Append, or attach to the first match of the same text and noise."""
    for other in matches:
        if len(item.payload) < T.TOO_BIG and item.chaos == other.chaos and item.decoded() == other.decoded():
            item.text = None
            other.submatches.append(item)
            return
    matches.append(item)


def cut_chunks(payload: bytes, encoding: str, offsets: range, size: int, mark: bytes = b"", strip: bool = False, multi_byte: bool | None = None, text: str | None = None, deferred: bool = False) -> Iterator[str]:
    """Samples of ``size`` bytes of a payload as text, one from each offset on; UnicodeError where one isn't valid.
    ``mark`` is the payload's byte-order mark, if it has one of this encoding, and ``strip`` leaves it out. ``text`` is the whole
    payload decoded, by which samples of multi-byte encodings are moved to where a character begins; without it
    (``deferred``: because the payload is too large) they begin where they fall."""
    n = len(payload)
    multi_byte = T.is_multi_byte(encoding) if multi_byte is None else multi_byte
    if text is not None and encoding.startswith("iso2022_"):
        for at in offsets:
            part = text[at * len(text) // n :][:size]
            if not part:
                return
            yield part
    elif not multi_byte and not deferred:
        base = payload[len(mark) if strip else 0 :]
        parts = [base[at : at + size] for at in offsets]
        parts = parts[: parts.index(b"")] if b"" in parts else parts
        yield from [strict(x, encoding) for x in parts]  # all are valid, or none counts
    else:
        kept = b"" if strip else mark
        whole = [(at, min(at + size, n)) for at in offsets if at + size <= n + 8]
        if not multi_byte:
            yield from [strict(kept + payload[a:b], encoding) for a, b in whole]
            return
        for a, b in whole:
            yield _aligned(payload, encoding, text, kept, a, b, min(size, 16))


def _aligned(payload: bytes, encoding: str, text: str | None, kept: bytes, a: int, b: int, head: int) -> str:
    """A sample may begin inside a character. It does if its beginning isn't in the text; then up to three bytes
    earlier are tried, and the last try stands."""
    part = lenient(kept + payload[a:b], encoding)
    if text is None or not a or part[:head] in text:
        return part
    for back in range(4):
        start = a - back if back <= a else max(0, len(payload) - (back - a))
        part = lenient(kept + payload[min(start, b) : b], encoding)
        if part[:head] in text:
            break
    return part


@dataclass
class _Candidate:
    encoding: str
    bom: bool
    stripped: int  # bytes of the mark that decoding leaves out
    multi_byte: bool
    languages: tuple[str, ...]


class _Run:
    def __init__(self, payload: bytes, options: Options):
        self.payload, self.options, self.trace = payload, options, []
        n = len(payload)
        self.steps, self.chunk = options.steps, options.chunk_size
        if n <= self.steps * self.chunk:
            self.steps, self.chunk = 1, n
        elif self.steps > 1:
            self.chunk = min(self.chunk, n // self.steps)
        self.large = n >= T.TOO_BIG
        self.marked, self.mark = signature(payload)
        self.declared = declared_encoding(payload) if options.preemptive else None
        self.only = {T.encoding_name(x, strict=False) for x in options.only}
        self.without = {T.encoding_name(x, strict=False) for x in options.without}
        self.tested: set[str] = set()
        self.skipped: set[str] = set()
        self.results: list[Match] = []
        self.early: list[Match] = []
        self.fallbacks: dict[str, Match] = {}
        self.sure_languages: set[str] | None = None
        self.successes = 0
        self.sure_multi_byte = False
        if n < T.TOO_SMALL:
            self.say(5, f"Trying to detect encoding from a tiny portion of ({n}) byte(s).")

    def say(self, level: int, message: str) -> None:
        self.trace.append((level, message))

    def match(self, c: _Candidate, chaos: float, languages: Ratios, text: str | None) -> Match:
        return Match(self.payload, c.encoding, chaos, c.bom, languages, self.declared, text)

    def preferred(self, encoding: str) -> bool:
        return encoding in ("ascii", "utf_8", self.declared)

    def admitted(self, encoding: str) -> _Candidate | None:
        if self.only and encoding not in self.only or encoding in self.without or encoding in self.tested:
            return None
        self.tested.add(encoding)
        bom = encoding == self.marked
        if encoding in ("utf_16", "utf_32", "utf_7") and not bom or encoding in self.skipped:
            return None
        multi_byte, languages = T.is_multi_byte(encoding), T.target_languages(encoding)
        if self.sure_languages is not None and (self.sure_languages.isdisjoint(languages) or not multi_byte and self.successes >= 7):
            return None
        if self.sure_multi_byte and not multi_byte:
            return None
        return _Candidate(encoding, bom, len(self.mark) if bom and encoding not in ("utf_16", "utf_32") else 0, multi_byte, languages)

    def chunks(self, c: _Candidate, text: str | None) -> Iterator[str]:
        """Samples of the payload as text; UnicodeError ends the candidate."""
        n = len(self.payload)
        offsets = range(len(self.mark) if c.bom else 0, n, max(1, n // self.steps))
        return cut_chunks(self.payload, c.encoding, offsets, self.chunk, self.mark if c.bom else b"", bool(c.stripped), c.multi_byte, text, self.large)

    def scored(self, parts: Iterator[str], most: int, one: bool, likely: bool) -> Generator[list[str], dict[str, Noise], tuple[list[str], list[float], int]]:
        """The samples as far as they are read, their noise, and how many reach the threshold; ``most`` that do are
        enough, or ``one`` at all. As many as can end it are asked for first, then the rest; all at once of a ``likely``
        candidate. What is invalid counts only if reading gets there."""
        seen, noise, over = [], [], 0
        size = 1 if one else -1 if likely else most
        while True:
            group, invalid = [], None
            try:
                for part in parts:
                    group.append(part)
                    if len(group) == size:
                        break
            except UnicodeError as error:
                invalid = error
            known = (yield group) if group else {}
            for part in group:
                ratio, details = known[part]
                if self.options.explain and 1 <= len(self.only) <= 2:
                    self.trace += [(5, f"{name}: {x!r}") for name, x in zip(NAMES, details, strict=True)]
                seen.append(part)
                noise.append(ratio)
                over += ratio >= self.options.threshold
                if over >= most or one:
                    return seen, noise, over
            if invalid is not None:
                raise invalid
            if len(group) != size:
                return seen, noise, over
            size = -1

    def tried(self, encoding: str) -> Asking:
        """The final answer, if this candidate settles it."""
        c = self.admitted(encoding)
        if c is None:
            return None
        source = self.payload[c.stripped :]
        try:
            text = None
            if self.large and not c.multi_byte:
                strict(source[:LARGE_PREFIX], encoding)
            elif c.multi_byte:
                text = strict(self.payload if encoding == "utf_7" and c.bom else source, encoding)
                if encoding == "utf_7" and c.bom:
                    text = text.removeprefix("﻿")
            offsets = range(len(self.mark) if c.bom else 0, len(self.payload), max(1, len(self.payload) // self.steps))
            most = max(len(offsets) // 4, 2)
            seen, noise, over = yield from self.scored(self.chunks(c, text), most, c.bom and not c.stripped, self.preferred(encoding))
            mean = sum(noise) / len(noise) if noise else 0.0
            rejected = mean >= self.options.threshold or over >= most
            if self.large and not c.multi_byte and not rejected:
                strict(self.payload[LARGE_CHECK:], encoding)
        except UnicodeError:
            return None
        if rejected:
            self.skipped.update(T.SIMILAR.get(encoding, "").split())
            self._fall_back(c, source, text)
            return None
        if not c.multi_byte and not self.large:
            try:
                whole = strict(source, encoding)
            except UnicodeError:
                return None
            if self.preferred(encoding):
                text = whole
        merged = []
        if encoding != "ascii":
            yield [(x, self.options.language_threshold, c.languages) for x in seen]
            merged = merge(coherence_ratio(x, self.options.language_threshold, c.languages) for x in seen)
        return self._accepted(c, mean, merged, text)

    def _fall_back(self, c: _Candidate, source: bytes, text: str | None) -> None:
        encoding = c.encoding
        if not self.options.fallback or encoding not in ("ascii", "utf_8", "utf_16", "utf_32", self.declared):
            return
        if text is None:
            try:
                text = strict(source, encoding)
            except UnicodeError:
                return
            text = None if self.large else text
        slot = "declared" if encoding == self.declared else "ascii" if encoding == "ascii" else "unicode"
        self.fallbacks[slot] = self.match(c, self.options.threshold, [], text)

    def _accepted(self, c: _Candidate, mean: float, languages: Ratios, text: str | None) -> list[Match] | None:
        encoding, n = c.encoding, len(self.payload)
        preferred = self.preferred(encoding)
        found = self.match(c, mean, languages, text if not self.large or preferred else None)
        fold(self.results, self.match(c, mean, languages, found.text))
        if self.sure_languages is not None and not c.multi_byte and mean < 0.02:
            self.successes += 1
        if preferred and mean < 0.1:
            if mean == 0.0:
                self.say(10, f"Encoding detection: {encoding} is most likely the one.")
                return [found]
            fold(self.early, self.match(c, mean, languages, found.text))
        baseline = {"ascii", "utf_8"} <= self.tested
        if self.early and baseline and (self.declared is None or self.declared in self.tested):
            return ranked(self.early)[:1]
        best = max((x for _, x in languages), default=0.0)
        if self.sure_languages is None and not c.multi_byte and best >= 0.5 and baseline:
            self.sure_languages = set(c.languages)
        if c.multi_byte and baseline and encoding not in UNICODE and len(text or "") < n * 0.98:
            self.sure_multi_byte = True
        return [found] if encoding == self.marked else None

    def answer(self) -> Asking:
        first = [x for x in (self.marked, self.declared, "ascii", "utf_8") if x]
        for encoding in (*first, *T.candidates()):
            settled = yield from self.tried(encoding)
            if settled is not None:
                return settled
        if not self.results:
            self.results = next(([self.fallbacks[k]] for k in ("declared", "unicode", "ascii") if k in self.fallbacks), [])
        out = ranked(self.results)
        if out:
            self.say(10, f"Encoding detection: Found {out[0].encoding} as plausible (best-candidate) for content. With {len(out) - 1} alternatives.")
            if self.options.explain and len(out) > 1:
                self.say(5, f"Alternatives: {', '.join(m.encoding for m in out[1:])}.")
        else:
            self.say(10, "Encoding detection: Unable to determine any suitable charset.")
        return out


Answer = tuple[list[Match], list[tuple[int, str]]]


def detect(payload: bytes, options: Options | None = None) -> Answer:
    """The matches of a payload, the best first, and what was noted on the way as (level, message)."""
    return detect_many([payload], options)[0]


def detect_many(payloads: Sequence[bytes], options: Options | None = None) -> list[Answer]:
    """:func:`detect` of each payload, side by side: each tries its own candidates in turn, but what they ask to be
    scored meanwhile is scored together."""
    options = options or Options()
    out: list[Answer] = [([], [])] * len(payloads)
    asking: list[tuple[int, _Run, Asking, list]] = []

    def go_on(i: int, run: _Run, answer: Asking, known: dict[str, Noise] | None) -> None:
        try:
            asking.append((i, run, answer, answer.send(known)))
        except StopIteration as end:
            out[i] = end.value, run.trace

    for i, payload in enumerate(payloads):
        if not isinstance(payload, bytes | bytearray):
            raise TypeError(f"expected bytes, not {type(payload).__name__}")
        if payload:
            run = _Run(bytes(payload), options)
            go_on(i, run, run.answer(), None)
        else:
            out[i] = [Match(b"", "utf_8", 0.0, False, [], None, "")], [(10, "Encoding detection on empty bytes, assuming utf_8 intention.")]
    while asking:
        wanted = [x for _, _, _, samples in asking for x in samples]
        known = _scores((x for x in wanted if isinstance(x, str)), options.threshold)
        K.prepare(x for x in wanted if not isinstance(x, str))
        now, asking = asking, []
        for i, run, answer, _ in now:
            go_on(i, run, answer, known)
    return out


def trials(payload: bytes, options: Options | None = None) -> list[dict]:
    """Every candidate for itself, without the early ends of :func:`detect`: place in the order of trial, encoding, the
    mark that it is marked by, whether all of the payload is valid in it, the noise of each sample, and whether that
    rejects it. What explains an answer, at a hundred times its cost."""
    options, out = options or Options(), []
    run = _Run(payload, options)
    first = [x for x in (run.marked, run.declared, "ascii", "utf_8") if x]
    only, without = run.only, run.without
    for encoding in dict.fromkeys((*first, *T.candidates())):
        if only and encoding not in only or encoding in without:
            continue
        bom, multi_byte = encoding == run.marked, T.is_multi_byte(encoding)
        strip = bom and encoding not in ("utf_16", "utf_32")
        try:
            text = strict(payload[len(run.mark) if strip else 0 :], encoding)
            offsets = range(len(run.mark) if bom else 0, len(payload), max(1, len(payload) // run.steps))
            samples = list(cut_chunks(payload, encoding, offsets, run.chunk, run.mark if bom else b"", strip, multi_byte, text if multi_byte else None))
            known = _scores(samples, options.threshold)
            noise = [known[x][0] for x in samples]
            valid = True
        except UnicodeError:
            noise, valid = [], False
        over = sum(x >= options.threshold for x in noise)
        rejected = not valid or bool(noise) and (sum(noise) / len(noise) >= options.threshold or over >= max(len(noise) // 4, 2))
        out.append({"ordinal": len(out), "encoding": encoding, "marked": bom, "valid": valid, "noise": noise, "rejected": rejected})
    return out


def forget() -> None:
    """Empty the memory of samples that were scored before."""
    _scored.clear()
    K.forget()


def is_binary(payload: bytes, options: Options | None = None) -> bool:
    """Whether no encoding fits, fallbacks aside."""
    return not detect(payload, without_fallback(options))[0]


def without_fallback(options: Options | None = None) -> Options:
    return replace(options or Options(), fallback=False)


def legacy(payload: bytes, rename: bool = False) -> dict[str, object]:
    """Encoding, language and confidence, under the names and rules of an older detector of that interface."""
    return legacy_of(detect(payload)[0], payload, rename)


def legacy_of(found: list[Match], payload: bytes, rename: bool = False) -> dict[str, object]:
    """:func:`legacy` from a payload's matches."""
    if not found:
        return {"encoding": None, "language": "", "confidence": None}
    best = found[0]
    encoding, confidence = best.encoding, 1.0 - best.chaos
    if confidence >= 0.9 and encoding not in ("utf_8", "ascii") and not best.bom and len(payload) < T.TOO_SMALL:
        confidence -= 0.2
    if encoding == "utf_8" and best.bom:
        encoding = "utf_8_sig"
    if not rename:
        encoding = T.LEGACY_NAMES.get(encoding, encoding)
    return {"encoding": encoding, "language": "" if best.language == "Unknown" else best.language, "confidence": confidence}
