"""Detection over DataFrames of payloads: a binary column in, matches as ordinary columns out.

Each payload is judged within its row, in Arrow batches. Nothing is shuffled but small inputs, whose rows are dealt out to
all cores first (:func:`spread`). Select what is needed before: the batch function is opaque to column pruning.
"""

from __future__ import annotations

import json
import textwrap
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import tables as T

RATIO = pa.struct([("language", pa.string()), ("ratio", pa.float64())])
MATCH = pa.struct(
    [
        ("rank", pa.int32()),
        ("encoding", pa.string()),
        ("chaos", pa.float64()),
        ("percent_chaos", pa.float64()),
        ("coherence", pa.float64()),
        ("percent_coherence", pa.float64()),
        ("bom", pa.bool_()),
        ("languages", pa.list_(RATIO)),
        ("language", pa.string()),
        ("could_be_from", pa.list_(pa.string())),
        ("declared", pa.string()),
        ("multi_byte_usage", pa.float64()),
    ]
)
MATCH_SQL = (
    "struct<rank:int,encoding:string,chaos:double,percent_chaos:double,coherence:double,percent_coherence:double,bom:boolean,languages:array<struct<language:string,ratio:double>>,"
    "language:string,could_be_from:array<string>,declared:string,multi_byte_usage:double>"
)
#: Rows handed to the kernel at once; a batch holds whole payloads.
ROWS = 256
#: Bytes of payloads that are judged side by side: their texts are held meanwhile.
TOGETHER_BYTES = 4 << 20


def match_row(rank: int, m: D.Match) -> dict:
    return {
        "rank": rank,
        "encoding": m.encoding,
        "chaos": m.chaos,
        "percent_chaos": round(m.chaos * 100, 3),
        "coherence": m.coherence,
        "percent_coherence": round(m.coherence * 100, 3),
        "bom": m.bom,
        "languages": [{"language": k, "ratio": v} for k, v in m.languages],
        "language": m.language,
        "could_be_from": m.could_be_from,
        "declared": m.declared,
        "multi_byte_usage": m.multi_byte_usage,
    }


#: Bytes of input that a task should have at most before the kernel, where tasks are fewer than cores.
TASK_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, if by its size the input would be fewer tasks than there are. The kernel takes a thousand
    times as long as the shuffle of a payload; a small file is one task whatever its rows cost. Large inputs stay where
    they are."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(4 * cores) if size < cores * TASK_BYTES else df


def together(payloads: list[bytes | None]) -> Iterator[range]:
    """Rows whose payloads are judged side by side: about ``TOGETHER_BYTES``, a larger payload by itself."""
    low = size = 0
    for i, p in enumerate(payloads):
        n = len(p or b"")
        if i > low and size + n > TOGETHER_BYTES:
            yield range(low, i)
            low, size = i, 0
        size += n
    yield range(low, len(payloads))


def _mapped(df: DataFrame, column: str, keep: Sequence[str] | None, added: list[tuple[str, str, pa.DataType]], of, named: str | None = None, detected: D.Options | None = None) -> DataFrame:
    """``df``'s columns to keep (all but the payload if None) and those that ``of`` gives for each payload, and for the
    value of the kept column ``named``, if one is. With ``detected`` payloads are judged side by side under these options,
    and ``of`` is given the answer first."""
    keep = [c for c in df.columns if c != column] if keep is None else list(keep)
    columns = list(dict.fromkeys([*keep, column]))
    at, kept = columns.index(column), [columns.index(c) for c in keep]
    kinds = dict(df.dtypes)
    if kinds[column] not in ("binary", "string"):
        raise TypeError(f"{column} is {kinds[column]}, not binary")

    def judged(payloads: list[bytes | None], more: list[tuple]) -> Iterator[tuple]:
        for rows in together(payloads):
            there = [i for i in rows if payloads[i] is not None]
            answers = dict(zip(there, D.detect_many([payloads[i] for i in there], detected), strict=True)) if detected else {}
            for i in rows:
                if payloads[i] is None:
                    yield (None,) * len(added)
                else:
                    yield of(*([answers.pop(i)] if detected else []), payloads[i], *more[i])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                b = whole.slice(low, ROWS)
                more = [()] * b.num_rows if named is None else [(x,) for x in b.column(columns.index(named)).to_pylist()]
                out = list(judged([x.as_buffer().to_pybytes() if x.is_valid else None for x in b.column(at)], more))
                values = [pa.array([r[i] for r in out], kind) for i, (_, _, kind) in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *values], names=[*keep, *(name for name, _, _ in added)])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{name}` {sql}" for name, sql, _ in added)])
    return spread(df.select(*columns)).mapInArrow(rows, schema)


def charset_matches(df: DataFrame, column: str = "payload", options: D.Options | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """With ``matches``, the ranked plausible encodings of each payload (null for a null payload, empty for a binary
    one), and ``trace``, what detection noted."""
    options = options or D.Options()

    def of(answer: D.Answer, payload: bytes):
        found, trace = answer
        return [match_row(i, m) for i, m in enumerate(found)], [{"level": a, "message": b} for a, b in trace]

    trace = pa.list_(pa.struct([("level", pa.int32()), ("message", pa.string())]))
    return _mapped(df, column, keep, [("matches", f"array<{MATCH_SQL}>", pa.list_(MATCH)), ("trace", "array<struct<level:int,message:string>>", trace)], of, detected=options)


def detect_best(df: DataFrame, column: str = "payload", options: D.Options | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """With ``best``, the first match, null where there is none."""
    options = options or D.Options()

    def of(answer: D.Answer, payload: bytes):
        found, _ = answer
        return (match_row(0, found[0]) if found else None,)

    return _mapped(df, column, keep, [("best", MATCH_SQL, MATCH)], of, detected=options)


def all_matches(df: DataFrame, column: str = "payload", options: D.Options | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """One row for each match; a payload without any has one row of nulls."""
    out = charset_matches(df, column, options, keep).drop("trace")
    return out.select("*", F.explode_outer("matches").alias("match")).drop("matches").select(*[c for c in out.columns if c != "matches"], "match.*")


def with_binary_flag(df: DataFrame, column: str = "payload", options: D.Options | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """With ``is_binary``: no encoding fits."""
    return _mapped(df, column, keep, [("is_binary", "boolean", pa.bool_())], lambda answer, p: (not answer[0],), detected=D.without_fallback(options))


def legacy_detect(df: DataFrame, column: str = "payload", rename: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """With encoding, language and confidence as an older detector names them."""

    def of(answer: D.Answer, payload: bytes):
        found = D.legacy_of(answer[0], payload, rename)
        return found["encoding"], found["language"], found["confidence"]

    return _mapped(df, column, keep, [("encoding", "string", pa.string()), ("language", "string", pa.string()), ("confidence", "double", pa.float64())], of, detected=D.Options())


def normalize(df: DataFrame, column: str = "payload", target: str = "utf_8", options: D.Options | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """With ``encoding`` (the best match's), ``output`` (the payload in the target encoding, declarations inside it
    updated) and ``output_text``; null for a binary payload."""
    options = options or D.Options()
    T.encoding_name(target)

    def of(answer: D.Answer, payload: bytes):
        found, _ = answer
        if not found:
            return None, None, None
        text = found[0].output_text(target)
        return found[0].encoding, text.encode(target, "replace"), text

    return _mapped(df, column, keep, [("encoding", "string", pa.string()), ("output", "binary", pa.binary()), ("output_text", "string", pa.string())], of, detected=options)


def report_rows(df: DataFrame, path: str = "path", column: str = "payload", options: D.Options | None = None, alternatives: bool = False, sink: Callable[[str, D.Match | None], str | None] | None = None, ranked: bool = False) -> DataFrame:
    """The rows of a report on files: path, encoding, encoding_aliases, alternative_encodings, language, alphabets,
    has_sig_or_bom, chaos and coherence in percent, unicode_path, is_preferred. Without a match one row of chaos 100;
    with ``alternatives`` also the matches after the best one. ``sink`` writes the best match's text somewhere, which is
    its unicode_path, so that a file is detected once; ``ranked`` adds the matches' rank."""
    options = options or D.Options()
    fields = [
        ("encoding", "string", pa.string()),
        ("encoding_aliases", "array<string>", pa.list_(pa.string())),
        ("alternative_encodings", "array<string>", pa.list_(pa.string())),
        ("language", "string", pa.string()),
        ("alphabets", "array<string>", pa.list_(pa.string())),
        ("has_sig_or_bom", "boolean", pa.bool_()),
        ("chaos", "double", pa.float64()),
        ("coherence", "double", pa.float64()),
        ("unicode_path", "string", pa.string()),
        ("is_preferred", "boolean", pa.bool_()),
    ]
    row = pa.struct([(n, t) for n, _, t in fields])

    def of(answer: D.Answer, payload: bytes, name: str):
        found, _ = answer
        if not found:
            return ([dict(zip(row.names, (None, [], [], "Unknown", [], False, 1.0, 0.0, None, True), strict=True))],)
        kept = found if alternatives else found[:1]
        place = sink(name, found[0]) if sink else None
        return ([dict(zip(row.names, (m.encoding, T.aliases(m.encoding), m.could_be_from[1:], m.language, m.alphabets, m.bom, round(m.chaos * 100, 3), round(m.coherence * 100, 3), None if i else place, not i), strict=True)) for i, m in enumerate(kept)],)

    sql = f"array<struct<{','.join(f'{n}:{s}' for n, s, _ in fields)}>>"
    return _mapped(df, column, [path], [("rows", sql, pa.list_(row))], of, path, options).select(path, F.posexplode("rows").alias("rank", "r")).select(path, *["rank"] * ranked, "r.*")


TRIAL_SQL = "array<struct<ordinal:int,encoding:string,marked:boolean,valid:boolean,noise:array<double>,rejected:boolean>>"
TRIAL = pa.list_(pa.struct([("ordinal", pa.int32()), ("encoding", pa.string()), ("marked", pa.bool_()), ("valid", pa.bool_()), ("noise", pa.list_(pa.float64())), ("rejected", pa.bool_())]))


def trials(df: DataFrame, column: str = "payload", options: D.Options | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """A row for each payload and candidate, tried without early ends: ordinal, encoding, marked, valid, noise (of each
    sample), mean_noise, rejected. For explanations: detection itself stops where it can."""
    out = _mapped(df, column, keep, [("_trials", TRIAL_SQL, TRIAL)], lambda p: (D.trials(p, options),))
    kept = [c for c in out.columns if c != "_trials"]
    each = out.select(*kept, F.explode("_trials").alias("t")).select(*kept, "t.*")
    return each.withColumn("mean_noise", F.aggregate("noise", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("noise"), F.lit(1)))


def to_json(rows: Iterable[dict]) -> Iterator[str]:
    """One report as an object, several as a list, in parts as they come; ASCII only, indented by 4."""
    rows = iter(rows)
    first, second = next(rows, None), next(rows, None)
    if first is None or second is None:
        yield json.dumps([] if first is None else first, ensure_ascii=True, indent=4)
        return
    before = "[\n"
    for row in chain((first, second), rows):
        yield before + textwrap.indent(json.dumps(row, ensure_ascii=True, indent=4), "    ")
        before = ",\n"
    yield "\n]"
