"""Log-structured runs: the distinct texts of a table in immutable blocks, and merges of their sorted key lists.

A *run* is one row that holds some hundreds of distinct texts. Steps that compare all texts with all texts sort the
keys of each run (:func:`sorted_keys`), cut the list by key range into buckets, and merge each bucket over all runs
(:func:`merge`). What returns to a run is one small number for each of its keys, in the run's own order, so no key
travels twice. A key has one entry for each run at most, however many rows it has, and where runs are many, one for each
share of them: hot keys are gathered before they meet. Buckets are sized by the number of keys (:func:`buckets_for`), so a merge fits in memory at any input size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import release, steady
from .store import Scope

RUN_BYTES, RUN_TEXTS = 2 << 20, 1 << 16
KEYS_PER_BUCKET = 2_000_000
#: In a run, stands for null.
NO_ID = -(1 << 63)

MEMBER = "doc_id bigint, digest binary, n_words bigint"
RUN = "run_id bigint, digests binary, n_words binary, ids binary, copies binary, ends binary, texts binary"
RUN_COLUMNS = [x.split()[0] for x in RUN.split(", ")]


def members(docs: DataFrame, lower: bool, texts: bool, key: Column | None = None) -> DataFrame:
    """For each row: doc_id, digest (SHA-256 of its words joined by one space), n_words; with ``texts`` also those
    joined words, compressed; with ``key``, a long of its own, also that. Words are separated by 0x20 and 0x09-0x0D; null
    has none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            digest, count, packed = [], [], []
            for x in b.column(1):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                found = (raw.lower() if lower else raw).split()  # of bytes: A-Z alone
                joined = b" ".join(found)
                digest.append(hashlib.sha256(joined).digest())
                count.append(len(found))
                if texts:
                    packed.append(pack(joined))
            columns = [b.column(0), pa.array(digest, pa.binary()), pa.array(count, pa.int64())]
            names = ["doc_id", "digest", "n_words"]
            if texts:
                columns, names = [*columns, pa.array(packed, pa.binary())], [*names, "z"]
            if with_key:
                columns, names = [*columns, b.column(2)], [*names, "key"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    with_key = key is not None
    own = docs.select(F.col("doc_id").cast("long"), F.col("text"), *([key.alias("key")] if with_key else []))
    return own.mapInArrow(steady(rows), MEMBER + ", z binary" * texts + ", key bigint" * with_key)


def runs(docs: DataFrame, lower: bool, least_words: int = 1) -> DataFrame:
    """Runs of the distinct texts of at least ``least_words`` words, with size, their number of words, to size buckets
    by. A text keeps the smallest doc_id and the number of its rows. Write the result before use: run_id holds for one
    execution."""
    each = members(docs, lower, texts=True).where(F.col("n_words") >= least_words)
    distinct = each.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), F.first("z").alias("z"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress

        def flush() -> pa.RecordBatch:
            nonlocal made, held, size
            texts = [x[4] for x in held]
            row = [
                (task << 24) + made, b"".join(x[0] for x in held), np.array([x[3] for x in held], np.int64).tobytes(),
                np.array([NO_ID if x[1] is None else x[1] for x in held], np.int64).tobytes(), np.array([x[2] for x in held], np.int64).tobytes(),
                np.cumsum([len(x) for x in texts]).astype(np.int64).tobytes(), pack(b"".join(texts)),
            ]
            words = sum(x[3] for x in held)
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:]), pa.array([words], pa.int64())], names=[*RUN_COLUMNS, "size"])

        for b in batches:
            for digest, i, copies, n, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append((digest, i, copies, n, unpack(z)))
                size += len(held[-1][4])
                if size >= RUN_BYTES or len(held) >= RUN_TEXTS:
                    yield flush()
        if held:
            yield flush()

    return distinct.select("digest", "id", "copies", "n_words", "z").mapInArrow(steady(packed), RUN + ", size bigint")


class Run:
    """One unpacked run."""

    def __init__(self, row: dict):
        self.run_id = row["run_id"]
        self.digests = [row["digests"][i : i + 32] for i in range(0, len(row["digests"]), 32)]
        self.n_words, self.ids, self.copies, ends = (np.frombuffer(row[k], np.int64) for k in ("n_words", "ids", "copies", "ends"))
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]), np.uint8)
        self.offsets = np.concatenate([[0], ends])

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def buckets_for(keys: int) -> int:
    """A power of two, so that a bucket is a range of the keys' upper bits."""
    return 1 << max(4, math.ceil(math.log2(max(1, keys) / KEYS_PER_BUCKET + 1e-9)))


def cut(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted 64-bit keys; one entry more than buckets."""
    bits = buckets.bit_length() - 1
    edges = np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


def returned(flags: DataFrame, table: DataFrame) -> DataFrame:
    """Each run with what the merges found for it: got, an array of (bucket, found) in the order of buckets."""
    gathered = flags.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "found"))).alias("got"))
    return table.join(gathered, "run_id", "left")


#: One bucket of one run's sorted keys: keys, and a second value for each (a check hash, or a count).
PIECE = "bucket int, run_id bigint, keys binary, more binary"


#: A text with more than this share of all rows is hot: there can't be more such texts than one by the share.
HOT = 1 / 1000


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Each of ``rows`` (digest, ...) with what ``labels`` (digest, copies, ...) says of its digest, null if nothing. The
    labels of hot texts, a thousand at most, are broadcast; their rows are spread over all tasks."""
    total = labels.agg(F.sum("copies")).first()[0] or 0
    names = [c for c in labels.columns if c != "digest"]
    hot = labels.where(F.col("copies") > F.lit(HOT * total)).select(F.col("digest").alias("_hot"), F.struct(*names).alias("_known"))
    met = rows.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left")
    # a row that is done joins with nothing, by a key of its own
    key = F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(F.concat("digest", F.encode(F.monotonically_increasing_id().cast("string"), "UTF-8")))
    found = met.withColumn("_key", key).join(labels.select(F.col("digest").alias("_key"), F.struct(*names).alias("_found")), "_key", "left")
    return found.select(*rows.columns, *(F.coalesce(F.col(f"_known.{c}"), F.col(f"_found.{c}")).alias(c) for c in names))


#: Of more runs than these, pieces are gathered by shares of the runs before they are merged: a key that is in every run
#: then is as many entries of its bucket as there are shares.
RUNS_AT_ONCE = 4096


class Merge:
    """What a merge does with pieces of one bucket (dicts of run_id, keys, more)."""

    def found(self, rows: list[dict]) -> list[bytes]:
        """For each piece, the bytes that go back to its run: something for each key, by all pieces."""
        raise NotImplementedError

    def gathered(self, rows: list[dict]) -> tuple[bytes, bytes]:
        """keys and more of one piece that stands for all."""
        raise NotImplementedError

    def dealt(self, whole: dict, found: bytes, rows: list[dict]) -> list[bytes]:
        """From what was found for the gathered piece, what goes back to each of those that it stands for. They are
        thousands, so what is done to the whole is done once."""
        raise NotImplementedError


FOUND = "run_id bigint, bucket int, found binary"


def merge(scope: Scope, pieces: DataFrame, by: Merge, runs: int, history: DataFrame | None = None) -> DataFrame:
    """(run_id, bucket, found) of the pieces of so many runs, in the light of historical pieces, to which nothing goes
    back."""

    def result(rows: list[dict], out: list[bytes]) -> pa.Table:
        return pa.table({"run_id": pa.array([r["run_id"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "found": pa.array(out, pa.binary())})

    def of(table: pa.Table) -> pa.Table:
        release()
        rows = table.to_pylist()
        back = [(r, x) for r, x in zip(rows, by.found(rows), strict=True) if r["run_id"] >= 0]
        return result([r for r, _ in back], [x for _, x in back])

    shares = -(-runs // RUNS_AT_ONCE)
    if shares <= 1:
        every = pieces if history is None else pieces.unionByName(history)
        return every.groupBy("bucket").applyInArrow(of, FOUND)

    def gather(table: pa.Table) -> pa.Table:
        release()
        rows = table.to_pylist()
        keys, more = by.gathered(rows)
        return pa.table({"bucket": pa.array([rows[0]["bucket"]], pa.int32()), "run_id": pa.array([rows[0]["share"]], pa.int64()), "keys": pa.array([keys], pa.binary()), "more": pa.array([more], pa.binary())})

    def deal(of_share: pa.Table, table: pa.Table) -> pa.Table:
        release()
        (whole,), rows = of_share.to_pylist(), table.to_pylist()
        return result(rows, by.dealt(whole, whole["found"], rows))

    pieces = scope.table(pieces)
    shared = pieces.withColumn("share", F.pmod(F.xxhash64("run_id"), F.lit(shares)).cast("long"))
    unions = scope.table(shared.groupBy("bucket", "share").applyInArrow(gather, PIECE))
    answers = merge(scope, unions, by, 1, history)
    answered = unions.join(answers, ["run_id", "bucket"]).withColumnRenamed("run_id", "share")
    return answered.groupBy("bucket", "share").cogroup(shared.groupBy("bucket", "share")).applyInArrow(deal, FOUND)
