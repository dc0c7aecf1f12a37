"""Detection of single payloads on the driver, for use without a DataFrame."""

from __future__ import annotations

import logging
import os
from typing import BinaryIO

from .functions import detect as D
from .functions.detect import Match, Options
from .functions.tables import encoding_name

logger = logging.getLogger("textloom")
#: The level of what is noted of each candidate.
TRACE = 5


class Matches(list):
    """Ranked matches: by rank, or by an encoding's name or alias (KeyError if none)."""

    def best(self) -> Match | None:
        return self[0] if self else None

    first = best

    def append(self, match: Match) -> None:
        """Attach to the first match of the same text and noise, or add and rank anew."""
        if not isinstance(match, Match):
            raise ValueError(f"expected a match, not {type(match).__name__}")
        every = list(self)
        D.fold(every, match)
        self[:] = D.ranked(every)

    def __getitem__(self, key):
        if not isinstance(key, str):
            return super().__getitem__(key)
        name = encoding_name(key, strict=False)
        for m in self:
            if name in m.could_be_from:
                return m
        raise KeyError(key)


def set_logging_handler(level: int = logging.INFO, name: str = "textloom") -> None:
    """Show what detection notes."""
    target = logging.getLogger(name)
    target.setLevel(level)
    target.addHandler(logging.StreamHandler())


def backend_name() -> str:
    return "pyspark"


def from_bytes(payload: bytes | bytearray, **options) -> Matches:
    """With ``explain``, all that is noted is shown on the standard error output, whatever the logger's level."""
    wanted = Options(**options)
    found, trace = D.detect(payload, wanted)
    level, handler = logger.level, logging.StreamHandler()
    if wanted.explain:
        logger.addHandler(handler)
        logger.setLevel(TRACE)
    try:
        for of, message in trace:
            logger.log(of, message)
    finally:
        if wanted.explain:
            logger.removeHandler(handler)
            logger.setLevel(level)
    return Matches(found)


def from_fp(file: BinaryIO, **options) -> Matches:
    return from_bytes(file.read(), **options)


def from_path(path: str | os.PathLike, **options) -> Matches:
    with open(path, "rb") as file:
        return from_fp(file, **options)


def is_binary(source: bytes | bytearray | str | os.PathLike | BinaryIO, **options) -> bool:
    """Of a path, an open file or a payload."""
    if isinstance(source, str | os.PathLike):
        with open(source, "rb") as file:
            source = file.read()
    elif not isinstance(source, bytes | bytearray):
        source = source.read()
    return D.is_binary(bytes(source), Options(**options))


def detect(payload: bytes | bytearray, rename: bool = False) -> dict[str, object]:
    if not isinstance(payload, bytes | bytearray):
        raise TypeError(f"expected bytes, not {type(payload).__name__}")
    return D.legacy(bytes(payload), rename)
