"""How good and how fast detection is on payloads whose encoding is known: coverage, agreement with another detector,
latency."""

from __future__ import annotations

import codecs
import time
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import characters as C
from ..functions import detect as D
from ..functions import tables as T
from .detection import _mapped

#: Texts that agree in this share of their characters count as the same.
ENOUGH = 0.98


def equivalence(payload: bytes, a: str, b: str) -> float:
    """The share of the characters decoded by ``a`` that ``b`` decodes alike, place by place."""
    x, y = C.codes_of(payload.decode(a)), C.codes_of(payload.decode(b))
    n = min(len(x), len(y))
    return 1.0 - int(np.count_nonzero(x[:n] != y[:n])) / len(x)


def codec_name(name: str) -> str:
    try:
        return T.encoding_name(name)
    except ValueError:
        return codecs.lookup(name).name.replace("-", "_")


def agree(payload: bytes, expected: str | None, found: str | None) -> tuple[bool, float | None]:
    """Whether two names stand for the same text of a payload, and the equivalence if that had to be computed. No name
    means a binary payload."""
    if expected is None or found is None:
        return expected is found, None
    try:
        a, b = codec_name(expected), codec_name(found)
        if expected == found or a == b or {a, b} <= {"utf_8", "utf_8_sig"}:
            return True, None
        share = equivalence(payload, expected, found)
    except (LookupError, UnicodeError, ZeroDivisionError):
        return False, None
    return share >= ENOUGH, share


def evaluated(df: DataFrame, expected: str, column: str = "payload", options: D.Options | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """With ``detected``, ``success`` and ``equivalence`` against the name in the column ``expected`` (null: binary)."""
    options = options or D.Options()

    def of(answer: D.Answer, payload: bytes, name: str | None):
        found, _ = answer
        detected = found[0].encoding if found else None
        return detected, *agree(payload, name, detected)

    kept = [c for c in df.columns if c != column] if keep is None else list(dict.fromkeys([*keep, expected]))
    return _mapped(df, column, kept, [("detected", "string", pa.string()), ("success", "boolean", pa.bool_()), ("equivalence", "double", pa.float64())], of, expected, options)


def coverage(judged: DataFrame, *by: str) -> DataFrame:
    """(by..., total, successes, share) of :func:`evaluated` or :func:`compared`."""
    return judged.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("success").cast("long")).alias("successes"), F.avg(F.col("success").cast("double")).alias("share"))


def compared(df: DataFrame, other: str, column: str = "payload", keep: Sequence[str] | None = None) -> DataFrame:
    """With ``detected`` (as the single-answer view names it), ``success`` and ``equivalence`` against another detector's
    answer in the column ``other``."""

    def of(answer: D.Answer, payload: bytes, name: str | None):
        detected = D.legacy_of(answer[0], payload)["encoding"]
        return detected, *agree(payload, name, detected)

    kept = [c for c in df.columns if c != column] if keep is None else list(dict.fromkeys([*keep, other]))
    return _mapped(df, column, kept, [("detected", "string", pa.string()), ("success", "boolean", pa.bool_()), ("equivalence", "double", pa.float64())], of, other, D.Options())


def timed(df: DataFrame, column: str = "payload", options: D.Options | None = None, keep: Sequence[str] | None = None, rounds: int = 1, size_factor: int = 1, most_bytes: int | None = None) -> DataFrame:
    """With ``seconds``, the mean time of ``rounds`` detections of each payload, repeated ``size_factor`` times and cut at
    ``most_bytes``. The memory of texts seen before is emptied each time."""
    options = options or D.Options()

    def of(payload: bytes):
        payload, took = (payload * size_factor)[:most_bytes], 0.0
        for _ in range(rounds):
            D.forget()
            began = time.perf_counter()
            D.detect(payload, options)
            took += time.perf_counter() - began
        return (took / rounds,)

    return _mapped(df, column, keep, [("seconds", "double", pa.float64())], of)


def latency(times: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row: n, least, most, mean, deviation, variation (deviation by mean), p50, p95, p99."""
    s = F.col(seconds)

    def at(share: float) -> Column:
        return F.percentile(s, F.lit(share))

    return times.agg(F.count(s).alias("n"), F.min(s).alias("least"), F.max(s).alias("most"), F.avg(s).alias("mean"), F.stddev(s).alias("deviation"), (F.stddev(s) / F.avg(s)).alias("variation"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def slowest(times: DataFrame, n: int = 10, seconds: str = "seconds") -> DataFrame:
    return times.orderBy(F.desc(seconds)).limit(n)
