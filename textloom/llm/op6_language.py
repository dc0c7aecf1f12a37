"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs; white space, digits and marks between letters are one boundary
symbol. The vector of a trigram binds those of its letters, each permuted by its place:
V(abc) = rot2(a) * rot1(b) * c. A document is the bundle (sum) of its trigrams' vectors, a language the bundle of its
training documents, each document to length one so that long ones don't outweigh the rest, less the mean of all
languages, which holds what they share. A document's language is the prototype of greatest cosine with it.

Learning sees text and lang of the training documents alone; prediction sees text alone. Prototypes are sums over all
training documents, added up in integers, so their order doesn't matter; they are as many numbers as languages times
DIMENSIONS, which is what reaches the driver. Whole texts are used; a text is counted in pieces of bounded size.

A null text, or one without a letter, is ``und`` with score 0; so is any text if nothing was learned. Equal cosines go to
the first language by code point. Rows without lang teach nothing. Repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import steady
from .store import bound_batches
from .words import slices

DIMENSIONS = 512
#: Letters are dealt to this many vectors by code point; more letters than that share some.
CODEBOOK = 4096
SEED = 6
#: Prototypes are summed as integers of this part of a document's length.
SCALE = 1 << 20
#: Characters whose trigrams are counted at once.
PIECE = 1 << 18
UNKNOWN = "und"

_tables: list = []


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """By code point: symbol number (0: boundary), after lower-casing; and the symbols' vectors."""
    if not _tables:
        points = range(0x110000)
        letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in points), bool, 0x110000)
        symbol = np.zeros(0x110000, np.int32)
        for c in np.flatnonzero(letter).tolist():
            low = chr(c).lower()
            symbol[c] = ord(low[0]) % (CODEBOOK - 1) + 1
        vectors = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (CODEBOOK, DIMENSIONS), dtype=np.int8) * 2 - 1
        _tables.extend((symbol, vectors.astype(np.int8)))
    return _tables[0], _tables[1]


def trigram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of trigram numbers, a row for each."""
    _, v = _symbols()
    a, b, c = grams // (CODEBOOK * CODEBOOK), grams // CODEBOOK % CODEBOOK, grams % CODEBOOK
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


def bundles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bundled vectors, whether each text has a letter), by slices."""
    symbol, _ = _symbols()
    for low, high, data, offsets in slices(texts, PIECE):
        total = np.zeros((high - low, DIMENSIONS), np.float32)
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        # offsets in characters: bytes that begin one
        n = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets])
        # a boundary before and after each text, and runs of boundaries as one
        doc = np.repeat(np.arange(high - low), n + 2)
        padded = np.zeros(len(doc), np.int32)
        padded[np.arange(len(codes)) + 2 * np.repeat(np.arange(high - low), n) + 1] = symbol[codes]
        has = np.bincount(doc, weights=padded > 0, minlength=high - low) > 0
        keep = np.ones(len(padded), bool)
        keep[1:] = (padded[1:] > 0) | (padded[:-1] > 0) | (doc[1:] != doc[:-1])
        padded, doc = padded[keep], doc[keep]
        for at in range(0, len(padded), PIECE):
            _bundle(padded[at : at + PIECE + 2].astype(np.int64), doc[at : at + PIECE + 2], total)
        yield low, high, total, has


def _bundle(s: np.ndarray, doc: np.ndarray, total: np.ndarray) -> None:
    """Add the vectors of the trigrams that begin in all but the last two symbols."""
    inside = (doc[:-2] == doc[2:]) & (s[1:-1] + s[:-2] > 0)
    distinct, of = np.unique(((s[:-2] * CODEBOOK + s[1:-1]) * CODEBOOK + s[2:])[inside], return_inverse=True)
    if not len(distinct):
        return
    pair, counts = np.unique(doc[:-2][inside] * len(distinct) + of, return_counts=True)
    where, gram = pair // len(distinct), pair % len(distinct)
    vectors = trigram_vectors(distinct).astype(np.float32)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(where)], strict=True):
        total[where[i]] += counts[i:j].astype(np.float32) @ vectors[gram[i:j]]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def learn(docs: DataFrame, training: Column) -> dict[str, np.ndarray]:
    """Prototypes of the languages of the rows of ``docs`` (text, lang) where ``training`` holds."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            for low, high, vectors, has in bundles(b.column(0)):
                langs = np.array(b.column(1).slice(low, high - low).to_pylist(), dtype=object)
                unit = np.rint(_unit(vectors) * SCALE).astype(np.int64)
                for lang in set(langs[has]):
                    total[lang] = total.get(lang, 0) + unit[has & (langs == lang)].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    each = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInArrow(steady(sums), "lang string, v array<bigint>")
    added = each.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = added.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    found = {r["lang"]: np.array([x["x"] for x in r["v"]], np.float64) for r in rows}
    langs = sorted(found)
    if not langs:
        return {}
    matrix = _unit(np.array([found[x] for x in langs]))
    if len(langs) > 1:
        matrix = _unit(matrix - matrix.mean(axis=0))
    return dict(zip(langs, matrix, strict=True))


FOUND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and score, the greatest cosine (0 if below). Only texts travel to Python."""
    bound_batches(docs.sparkSession)
    langs = list(prototypes)
    matrix = np.array([prototypes[x] for x in langs], np.float32)

    def judged(texts: pa.Array) -> pa.Array:
        names, scores = [], [np.zeros(0)]
        for low, high, vectors, has in bundles(texts):
            if langs:
                cosine = _unit(vectors) @ matrix.T
                names += [langs[i] if h else UNKNOWN for i, h in zip(cosine.argmax(axis=1).tolist(), has.tolist(), strict=True)]
                scores.append(np.clip(np.where(has, cosine.max(axis=1), 0), 0, 1).astype(np.float64))
            else:
                names += [UNKNOWN] * (high - low)
                scores.append(np.zeros(high - low))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], fields=list(FOUND))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from steady(lambda batches: map(judged, batches))(texts)

    found = docs.select("*", of(F.col("text")).alias("_found"))
    return found.select(*docs.columns, "_found.lang_pred", "_found.score")


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score."""
    prototypes = learn(docs, ~held_out(F.col("doc_id")))
    return predict(docs.select("doc_id", "text"), prototypes).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
