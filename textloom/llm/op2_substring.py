"""Substring deduplication with a log-structured fingerprint index.

Every window of 35 consecutive words that starts anywhere else too, in another document or the same, counts as
repeated, and all words under repeated windows go.

1. Documents with equal words are gathered by digest. One text of each group enters the index; of a group of two or
   more every window is repeated, so its documents need nothing further.
2. The distinct texts form immutable runs. From each window the smallest of its 24 hashes of 12 words is taken: equal
   windows take equal ones. These fingerprints, about one for 12 words, are sorted within the run and merge-joined over
   all runs, by range.
3. Only windows whose fingerprint occurs twice are hashed whole, sorted, and merge-joined again by a first hash of 64
   bits and verified by a second. Both begin at the bytes of the words and mix them in trees with seeds of their own, so
   what agrees in all 128 bits is repeated: different windows of a corpus of 10**13 words agree by a chance of 10**-12.
4. Each run gets a bit for each of its windows and removes the covered words.

:class:`FingerprintIndex` keeps sorted runs of window hashes across batches. A new batch is merge-joined with the
historical runs in the same two steps, first by fingerprints, then by the two hashes of whole windows that verify it; its
own hashes are appended as runs that never change; compaction merges them, by range, into one run without repeats. History
is read as hashes and never hashed again; no text is kept. A table by itself is the first batch of an empty index.

Nulls, empty texts and texts under 35 words have no windows and lose nothing. Repeated rows and repeated doc_ids are
documents of their own, each with a result. Extra columns are ignored. An empty table gives an empty result. A text
that is longer than a run is a run of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs as R
from .memory import steady
from .store import Scope
from .words import NONSPACE, window_hashes, words

WINDOW, SHINGLE = 35, 12
EMPTY = hashlib.sha256(b"").hexdigest()


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive entries, by doubling."""
    done = 1
    while done * 2 <= width:
        h, done = np.minimum(h[:-done], h[done:]), done * 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


class _Windows:
    """The windows of one run: start word, and the smallest shingle hash inside."""

    def __init__(self, run: R.Run, window: int):
        shingle = min(SHINGLE, window)
        self.words = w = words(run.data, run.offsets, NONSPACE)
        self.h = w.hashes()
        n = len(self.h) - window + 1
        if n <= 0:
            self.at, self.least, self.chosen = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        whole = np.zeros(len(self.h) - shingle + 1, np.uint64)
        hashes, at = window_hashes(self.h, w.doc, shingle)
        whole[at] = hashes
        self.at = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
        width = window - shingle + 1
        self.least = _sliding_min(whole, width)[self.at]
        # the shingles that are the smallest of some window: equal to the largest minimum of the windows they are in
        most = np.zeros(len(whole) + width - 1, np.uint64)
        most[self.at + width - 1] = self.least
        most = ~_sliding_min(~most, width)
        self.chosen = whole[(whole == most) & (most > 0)]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct ones; whether each is at two places in this run."""
        keys, count = np.unique(self.chosen, return_counts=True)
        return keys, count > 1

    def keys(self, repeated: np.ndarray, prints: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """Windows whose fingerprint is repeated, as sorted distinct (key, check) pairs: key, check, whether it is
        twice in this run; then each candidate's start word and its place in those."""
        at = self.at[repeated[np.searchsorted(prints, self.least)]] if len(prints) else self.at
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), at, at
        # of the words under those windows alone
        under = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(under, at, 1)
        np.add.at(under, at + window, -1)
        of = np.flatnonzero(np.cumsum(under)[:-1])
        stretch = np.cumsum(np.diff(of, prepend=-1) > 1) + self.words.doc[of] * (len(of) + 1)
        (key, every), (check, _) = (window_hashes(h, stretch, window, seed) for seed, h in ((0, self.h[of]), (1, self.words.hashes(1, of))))
        pick = np.searchsorted(of[every], at)
        key, check = key[pick], check[pick]
        order = np.argsort(key, kind="stable")
        k, c = key[order], check[order]
        if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():
            order = np.lexsort((check, key))
            k, c = key[order], check[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        place = np.empty(len(k), np.int64)
        place[order] = np.cumsum(new) - 1
        twice = np.bincount(place, minlength=int(new.sum())) > 1
        return k[new], c[new], twice, at, place


def _bits(row: dict, sizes: np.ndarray, field: str = "got") -> np.ndarray:
    """The flags of a run's sorted keys, from the buckets' answers."""
    out = [np.unpackbits(np.frombuffer(x["found"], np.uint8), count=int(sizes[x["bucket"]])) for x in row[field] or []]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def _pieces(run_id: int, keys: np.ndarray, more: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    edges = R.cut(keys, buckets)
    full = np.flatnonzero(np.diff(edges))
    yield pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([run_id] * len(full), pa.int64()), *(pa.array([a[edges[i] : edges[i + 1]].tobytes() for i in full], pa.binary()) for a in (keys, more))],
        names=["bucket", "run_id", "keys", "more"],
    )


def _flags(row: dict, n: int, at: int = 0) -> np.ndarray:
    """Whether each key is twice in its run; history says nothing of that."""
    return np.frombuffer(row["more"][at:], bool) if row["run_id"] >= 0 else np.zeros(n, bool)


class _RepeatedPrints(R.Merge):
    """A fingerprint is repeated if it is in two runs or twice in one. more: whether it is twice."""

    def _flagged(self, rows: list[dict]) -> tuple[list[int], np.ndarray, np.ndarray]:
        each = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        keys = np.concatenate(each)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        flag = np.concatenate([_flags(r, len(e)) for r, e in zip(rows, each, strict=True)])
        flag[order[1:][same]] = True
        flag[order[:-1][same]] = True
        return [len(e) for e in each], keys, flag

    def found(self, rows: list[dict]) -> list[bytes]:
        sizes, _, flag = self._flagged(rows)
        return [np.packbits(x).tobytes() for x in np.split(flag, np.cumsum(sizes)[:-1])]

    def gathered(self, rows: list[dict]) -> tuple[bytes, bytes]:
        _, keys, flag = self._flagged(rows)
        keys, first = np.unique(keys, return_index=True)
        return keys.tobytes(), flag[first].tobytes()

    def dealt(self, whole: dict, found: bytes, rows: list[dict]) -> list[bytes]:
        every = np.frombuffer(whole["keys"], np.uint64)
        flag = np.unpackbits(np.frombuffer(found, np.uint8), count=len(every))
        return [np.packbits(flag[np.searchsorted(every, np.frombuffer(r["keys"], np.uint64))]).tobytes() for r in rows]


class _RepeatedWindows(R.Merge):
    """Keys and checks must agree. more: checks, then whether each is twice."""

    def _flagged(self, rows: list[dict]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, keys, checks and flags in the order of the rows; and the places of distinct windows, sorted."""
        each = [np.frombuffer(r["keys"], np.uint64) for r in rows]
        check = np.concatenate([np.frombuffer(r["more"][: 8 * len(e)], np.uint64) for r, e in zip(rows, each, strict=True)])
        flag = np.concatenate([_flags(r, len(e), 8 * len(e)) for r, e in zip(rows, each, strict=True)])
        keys = np.concatenate(each)
        order = np.lexsort((check, keys))
        k, c = keys[order], check[order]
        same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        flag[order[1:][same]] = True
        flag[order[:-1][same]] = True
        return [len(e) for e in each], keys, check, flag, order[np.concatenate([[True], ~same])]

    def found(self, rows: list[dict]) -> list[bytes]:
        sizes, _, _, flag, _ = self._flagged(rows)
        return [np.packbits(x).tobytes() for x in np.split(flag, np.cumsum(sizes)[:-1])]

    def gathered(self, rows: list[dict]) -> tuple[bytes, bytes]:
        _, keys, check, flag, first = self._flagged(rows)
        return keys[first].tobytes(), check[first].tobytes() + flag[first].tobytes()

    def dealt(self, whole: dict, found: bytes, rows: list[dict]) -> list[bytes]:
        every = np.frombuffer(whole["keys"], np.uint64)
        checks = np.frombuffer(whole["more"][: 8 * len(every)], np.uint64)
        flag = np.unpackbits(np.frombuffer(found, np.uint8), count=len(every))
        out = []
        for r in rows:
            own = np.frombuffer(r["keys"], np.uint64)
            check = np.frombuffer(r["more"][: 8 * len(own)], np.uint64)
            # all of the row's windows are in the whole; those of one key lie side by side, in the order of their checks
            place = np.searchsorted(every, own)
            while len(later := np.flatnonzero(checks[place] != check)):
                place[later] += 1
            out.append(np.packbits(flag[place]).tobytes())
        return out


def _recut(pieces: DataFrame, buckets: int) -> DataFrame:
    """Historical pieces (keys, more: checks or nothing) in the buckets of this merge."""

    def of(batches):
        for row in R.each_run(batches):
            keys = np.frombuffer(row["keys"], np.uint64)
            more = np.frombuffer(row["more"], np.uint64)
            edges = R.cut(keys, buckets)
            for i in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[i], edges[i + 1])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row["run_id"]], pa.int64()), pa.array([keys[part].tobytes()], pa.binary()), pa.array([more[part].tobytes()], pa.binary())], names=["bucket", "run_id", "keys", "more"])

    return pieces.select("bucket", F.lit(-1).cast("long").alias("run_id"), "keys", "more").mapInArrow(steady(of), R.PIECE)


def _judged(scope: Scope, table: DataFrame, window: int, history: tuple[DataFrame, DataFrame] | None = None, old: int = 0) -> DataFrame:
    """(digest, n_removed, kept_sha256, kept) of each text of the runs, judged against each other and the history's
    fingerprints and windows, of ``old`` words."""
    size, n_runs = table.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = (size or 0) + old
    narrow, wide = R.buckets_for(total // 8), R.buckets_for(total // 4 + old)

    def prints(batches):
        for row in R.each_run(batches):
            keys, twice = _Windows(R.Run(row), window).fingerprints()
            yield from _pieces(row["run_id"], keys, twice, narrow)

    def merged(pieces: DataFrame, by: R.Merge, which: int, buckets: int) -> DataFrame:
        return R.merge(scope, pieces, by, n_runs, None if history is None else _recut(history[which], buckets))

    first = R.returned(merged(table.mapInArrow(steady(prints), R.PIECE), _RepeatedPrints(), 0, narrow), table.drop("size"))

    def candidates(batches):
        for row in R.each_run(batches):
            run = R.Run(row)
            w = _Windows(run, window)
            keys, _ = w.fingerprints()
            repeated = _bits(row, np.diff(R.cut(keys, narrow)))
            key, check, twice, at, place = w.keys(repeated, keys, window)
            edges = R.cut(key, wide)
            full = np.flatnonzero(np.diff(edges))
            packed = np.packbits(repeated).tobytes()
            # the run's own row goes with bucket -1: what level one found, and nothing to merge
            rows = [(-1, row["run_id"], packed, b"")] + [(int(b), row["run_id"], key[edges[b] : edges[b + 1]].tobytes(), check[edges[b] : edges[b + 1]].tobytes() + twice[edges[b] : edges[b + 1]].tobytes()) for b in full]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "run_id", "keys", "more"])

    pieces = scope.table(first.mapInArrow(steady(candidates), R.PIECE))
    second = merged(pieces.where("bucket >= 0"), _RepeatedWindows(), 1, wide).unionByName(pieces.where("bucket < 0").select("run_id", "bucket", F.col("keys").alias("found")))
    both = R.returned(second, table.drop("size"))

    def removed(batches):
        for row in R.each_run(batches):
            run = R.Run(row)
            w = _Windows(run, window)
            keys, _ = w.fingerprints()
            got = row["got"] or []
            repeated = np.unpackbits(np.frombuffer(got[0]["found"], np.uint8), count=len(keys)).astype(bool) if got else np.zeros(0, bool)
            key, _, twice, at, place = w.keys(repeated, keys, window)
            flags = _bits({"got": got[1:]}, np.diff(R.cut(key, wide)))
            gone = np.zeros(len(w.h) + 1, np.int64)
            hit = at[flags[place]] if len(at) else at
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            n_removed = sums[w.words.first[1:]] - sums[w.words.first[:-1]]
            kept, sha = [], []
            for i, n in enumerate(n_removed):
                if n:
                    a, b = w.words.first[i], w.words.first[i + 1]
                    left = np.flatnonzero(~gone[a:b]) + a
                    text = b" ".join(run.data[s:e].tobytes() for s, e in zip(w.words.start[left].tolist(), w.words.end[left].tolist(), strict=True))
                    kept.append(text)
                    sha.append(hashlib.sha256(text).hexdigest())
                else:
                    kept.append(None)
                    sha.append(run.digests[i].hex())
            yield pa.RecordBatch.from_arrays([pa.array(run.digests, pa.binary()), pa.array(run.copies, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["digest", "copies", "n_removed", "kept_sha256", "kept"])

    return both.mapInArrow(steady(removed), "digest binary, copies bigint, n_removed bigint, kept_sha256 string, kept binary")


def _resulting(docs: DataFrame, judged: DataFrame, window: int, texts: bool) -> DataFrame:
    each = R.members(docs, lower=False, texts=False)
    copied = (F.col("copies") > 1) & (F.col("n_words") >= window)
    whole = F.lower(F.hex("digest"))
    return R.with_labels(each, judged).select(
        "doc_id",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", whole)).alias("kept_sha256"),
        *([F.when(copied, F.lit(b"")).otherwise(F.col("kept")).cast("string").alias("kept")] if texts else []),
    )


def repeated_substrings(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (SHA-256 of the kept words
    joined by one space); with ``texts`` also kept, those words, null where nothing went."""
    with Scope(docs.sparkSession) as s:
        table = s.table(R.runs(docs, lower=False, least_words=window))
        judged = s.table(_judged(s, table, window).select("digest", "copies", "n_removed", "kept_sha256", *["kept"] * texts))
        return s.keep(_resulting(docs, judged, window, texts))


#: A run of hashes: those of one range, sorted. more: the second hashes of windows; nothing for fingerprints.
HASHES = "bucket int, keys binary, more binary"


def _hash_runs(table: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Of runs of texts, the sorted distinct fingerprints and the sorted distinct windows, a run of hashes for each."""

    def prints(batches):
        for row in R.each_run(batches):
            keys, _ = _Windows(R.Run(row), window).fingerprints()
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["bucket", "keys", "more"])

    def windows(batches):
        for row in R.each_run(batches):
            w = _Windows(R.Run(row), window)
            keys, checks, *_ = w.keys(np.ones(1, bool), np.zeros(0, np.uint64), window)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([checks.tobytes()], pa.binary())], names=["bucket", "keys", "more"])

    return table.mapInArrow(steady(prints), HASHES), table.mapInArrow(steady(windows), HASHES)


def _compacted(runs: DataFrame, buckets: int) -> DataFrame:
    """One sorted run of each range, without repeats."""

    def of(pieces: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in pieces["keys"]])
        more = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in pieces["more"]])
        order = np.lexsort((more, keys)) if len(more) else np.argsort(keys, kind="stable")
        keys, more = keys[order], more[order] if len(more) else more
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        if len(more):
            new[1:] |= more[1:] != more[:-1]
            more = more[new]
        return pa.table({"bucket": pieces["bucket"][:1], "keys": pa.array([keys[new].tobytes()], pa.binary()), "more": pa.array([more.tobytes()], pa.binary())})

    return _recut(runs, buckets).groupBy("bucket").applyInArrow(of, HASHES)


class FingerprintIndex:
    """An index on ``path`` (a folder of any store Spark reaches) that grows by batches.

    ``add(docs)`` gives, for the batch, the result of :func:`repeated_substrings` judged against the batch and all
    earlier ones, then appends the batch's hashes as a level of runs. Files are never changed; a failed ``add`` leaves no
    visible level, since one is listed only once all its ``_SUCCESS`` files are there. ``compact()`` merges all levels into
    one run of each range, and then drops the old levels; if it ends between, hashes are there twice, which changes no
    result.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW):
        self.spark, self.path, self.window = spark, path.rstrip("/"), window

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _is_whole(self, level: str) -> bool:
        places = [self._fs(f"{level}/{part}/_SUCCESS") for part in ("prints", "windows")]
        return all(fs.exists(p) for p, fs in places)

    def levels(self) -> list[str]:
        p, fs = self._fs(self.path)
        if not fs.exists(p):
            return []
        return sorted(x for x in (str(x.getPath()) for x in fs.listStatus(p)) if self._is_whole(x))

    def _history(self) -> tuple[DataFrame, DataFrame] | None:
        old = self.levels()
        if not old:
            return None
        prints, windows = (self.spark.read.schema(HASHES).parquet(*(f"{x}/{part}" for x in old)) for part in ("prints", "windows"))
        return prints, windows

    def _words(self, windows: DataFrame) -> int:
        return windows.agg(F.sum(F.octet_length("keys"))).first()[0] // 8

    def _write(self, number: int, prints: DataFrame, windows: DataFrame) -> None:
        level = f"{self.path}/level-{number:05d}-{uuid.uuid4().hex}"
        prints.write.parquet(f"{level}/prints")
        windows.write.parquet(f"{level}/windows")

    def add(self, docs: DataFrame) -> DataFrame:
        history = self._history()
        with Scope(self.spark) as s:
            table = s.table(R.runs(docs, lower=False, least_words=self.window))
            judged = s.table(_judged(s, table, self.window, history, self._words(history[1]) if history else 0).select("digest", "copies", "n_removed", "kept_sha256"))
            out = s.keep(_resulting(docs, judged, self.window, False))
            self._write(len(self.levels()), *_hash_runs(table, self.window))
        return out

    def compact(self) -> None:
        """One level, with each distinct hash once."""
        old, history = self.levels(), self._history()
        if len(old) < 2:
            return
        buckets = R.buckets_for(self._words(history[1]))
        self._write(0, *(_compacted(x, buckets) for x in history))
        for x in old:
            p, fs = self._fs(x)
            fs.delete(p, True)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: By every window, every pair and every row: for small tables.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, p, array_to_string(w[p + 1 : p + 35], ' ') AS win FROM (SELECT r, w, unnest(range(0, len(w) - 34)) AS p FROM d WHERE len(w) >= 35)),
h AS (SELECT r, p FROM g JOIN (SELECT win FROM g GROUP BY win HAVING count(*) > 1) USING (win)),
c AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM h),
n AS (SELECT r, count(*) AS n_removed FROM c GROUP BY r),
l AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS q FROM d SEMI JOIN n USING (r)),
k AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS kept FROM l ANTI JOIN c USING (r, q) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(CASE WHEN n_removed IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
