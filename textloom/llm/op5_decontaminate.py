"""Benchmark decontamination by a prefix-filtered set join.

A window is 10 consecutive words of an item (a shorter item is one window). A document word inside any occurrence of a
window is hit. The join asks for containment one: all shingles of a window have to be in the document, so one token is
the necessary prefix.

1. The benchmark is dealt out by hash into blocks of about BLOCK_BYTES, and each block is made into an index by one task
   of the cluster: the shingles (3 words; 1 or 2 for items as short as that) of its windows are counted, and each window
   is filed under its rarest shingle, with that shingle's place in it.
2. Documents look their shingles up in the sorted index. A match at word p of a shingle at place q can only be a window
   that starts at p - q and ends inside the document: the positional and the length bound.
3. What is left and agrees in a hash is verified word by word.

Indexes are files in the shared folder; the driver sees their names alone. A worker holds the index of one block at a
time, meets each batch of documents with one after the other, and keeps the last ones while they take no more than
KEPT_BYTES: memory is bounded by the block and the batch, whatever the sizes. No document leaves its task.

Null and empty texts have no words, hit nothing and are not contaminated; items without words have no windows. Several
items may share a window: each counts. Rows with the same item_id are one item; item_ids of any type are compared and
listed as strings. Repeated documents each give a row; null item_ids are left out of items_sha256; extra columns are
ignored; empty tables are met with empty results. An item longer than a block is a block with what falls to it.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import register, steady
from .store import bound_batches, open_store, shared_dir
from .words import ALNUM, LOWER, Words, slices, window_hashes, words

WINDOW, SHINGLE = 10, 3
#: Of the benchmark's texts in one block, of indexes that a worker keeps, and of documents that meet them at a time.
BLOCK_BYTES, KEPT_BYTES, PORTION = 8 << 20, 64 << 20, 2 << 20


@dataclass
class Index:
    """Of windows of ``size`` words, under shingles of ``shingle`` words: sorted prefix hashes, and for each the place
    of the shingle, the window's hash, its words joined by a space, and the items that have it."""

    size: int
    shingle: int
    prefix: np.ndarray
    place: np.ndarray
    hash: np.ndarray
    text: list[bytes]
    items: list[tuple]


def _tokens(texts: pa.Array) -> Words:
    (piece,) = slices(texts, 1 << 62)
    return words(LOWER[piece[2]], piece[3], ALNUM)


def _joined(w: Words, start: int, size: int) -> bytes:
    return b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start[start : start + size].tolist(), w.end[start : start + size].tolist(), strict=True))


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW, shingle: int = SHINGLE) -> list[Index]:
    """One index for each length of window."""
    if not items:
        return []
    w = _tokens(pa.array([x[1] or "" for x in items], pa.large_string()))
    h, n = w.hashes(), np.diff(w.first)
    out = []
    for size in sorted({min(window, int(k)) for k in n if k}):
        own = min(shingle, size)
        hashes, at = window_hashes(h, w.doc, size)
        take = np.minimum(n, window)[w.doc[at]] == size
        hashes, at = hashes[take], at[take]
        small, where = window_hashes(h, w.doc, own)
        values, of, counts = np.unique(small, return_inverse=True, return_counts=True)
        rarity = np.zeros(len(h), np.int64)
        rarity[where] = counts[of]
        value = np.zeros(len(h), np.uint64)
        value[where] = small
        offsets = np.arange(size - own + 1)
        # the rarest shingle, of equally rare ones that of the smallest hash, so that equal windows take the same
        options = at[:, None] + offsets
        order = np.lexsort((value[options], rarity[options]), axis=-1)[:, 0]
        prefix = value[options[np.arange(len(at)), order]]
        entries: dict[tuple, set] = {}
        for i in range(len(at)):
            entries.setdefault((prefix[i], order[i], hashes[i], _joined(w, int(at[i]), size)), set()).add(items[int(w.doc[at[i]])][0])
        keys = sorted(entries)
        columns = list(zip(*keys, strict=True))
        out.append(Index(size, own, *(np.array(c, t) for c, t in zip(columns, (np.uint64, np.int64, np.uint64), strict=False)), list(columns[3]), [tuple(entries[k]) for k in keys]))
    return out


class Slice:
    """Some documents' words, with the hashes that indexes ask for."""

    def __init__(self, w: Words):
        self.w, self.h = w, w.hashes()
        self._of: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self._of:
            self._of[size] = window_hashes(self.h, self.w.doc, size)
        return self._of[size]


def find(s: Slice, index: list[Index]) -> tuple[np.ndarray, list[tuple[int, tuple]]]:
    """How many more windows begin than end at each word; and (document, items of the window) of all occurrences."""
    w = s.w
    edge = np.zeros(len(s.h) + 1, np.int64)
    found: list[tuple[int, tuple]] = []
    for x in index:
        small, where = s.windows(x.shingle)
        low = np.searchsorted(x.prefix, small)
        low[low == len(x.prefix)] = 0
        some = np.flatnonzero(x.prefix[low] == small)
        if not len(some):
            continue
        whole, at = s.windows(x.size)
        first, last = low[some], np.searchsorted(x.prefix, small[some], "right")
        # entries with the same prefix are few: as many passes as the most of them
        for step in range(int((last - first).max())):
            live = np.flatnonzero(first + step < last)
            entry = first[live] + step
            start = where[some[live]] - x.place[entry]
            place = np.minimum(np.searchsorted(at, start), len(at) - 1)
            ok = np.flatnonzero((at[place] == start) & (whole[place] == x.hash[entry])) if len(at) else []
            for e, p in zip(entry[ok].tolist(), start[ok].tolist(), strict=True):
                if _joined(w, p, x.size) == x.text[e]:
                    edge[p] += 1
                    edge[p + x.size] -= 1
                    found.append((int(w.doc[p]), x.items[e]))
    return edge, found


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(x for x in items if x is not None)).encode()).hexdigest()


def write_indexes(benchmark: DataFrame, folder: str, window: int = WINDOW) -> list[str]:
    """Files with the indexes of the blocks of ``benchmark`` (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES

    def made(table: pa.Table) -> pa.Table:
        index = build(list(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True)), window)
        fs, path = open_store(f"{folder}/index-{uuid.uuid4().hex}")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as out:
            pickle.dump(index, out, 5)
        return pa.table({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return sorted(r[0] for r in dealt.groupBy("block").applyInArrow(made, "path string").collect())


_loaded: OrderedDict[str, tuple[int, list[Index]]] = OrderedDict()


register("indexes", lambda: _loaded.clear())


def load(path: str) -> list[Index]:
    """The index of a file; the last ones stay while they fit in KEPT_BYTES."""
    if path not in _loaded:
        fs, name = open_store(path)
        with fs.open_input_stream(name) as f:
            data = f.read()
        while _loaded and sum(n for n, _ in _loaded.values()) + len(data) > KEPT_BYTES:
            _loaded.popitem(last=False)
        _loaded[path] = len(data), pickle.loads(data)
    _loaded.move_to_end(path)
    return _loaded[path][1]


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("hits", pa.list_(SPAN)), ("items", pa.list_(pa.string()))])
FOUND_SQL = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean,hits:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def _judge(texts: pa.Array, paths: list[str]) -> pa.Array:
    """FOUND of each text. Documents meet every block's index by portions of PORTION bytes."""
    out: list[tuple] = []
    for low, high, data, offsets in slices(texts, PORTION):
        s = Slice(words(LOWER[data], offsets, ALNUM))
        edge, items = np.zeros(len(s.h) + 1, np.int64), {}
        for path in paths:
            more, found = find(s, load(path))
            edge += more
            for doc, of in found:
                items.setdefault(doc, set()).update(of)
        out += _rows(s.w, high - low, np.cumsum(edge)[:-1] > 0, items)
    columns = list(zip(*out, strict=True)) or [()] * len(FOUND)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], fields=list(FOUND))


def _rows(w: Words, n_docs: int, hit: np.ndarray, items: dict[int, set]) -> Iterator[tuple]:
    none = _digest(())
    sums = np.concatenate([[0], np.cumsum(hit)])
    for i, n, n_hit in zip(range(n_docs), np.diff(w.first).tolist(), (sums[w.first[1:]] - sums[w.first[:-1]]).tolist(), strict=True):
        if not n_hit:
            yield n, 0, 0, none, False, (), ()
            continue
        turns = np.flatnonzero(np.diff(np.concatenate([[0], hit[w.first[i] : w.first[i + 1]].astype(np.int8), [0]]))).tolist()
        spans = [{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]
        yield n, n_hit, len(items[i]), _digest(items[i]), True, spans, sorted(x for x in items[i] if x is not None)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, spans: bool = False, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each row of ``docs`` (text, and the columns to ``keep``): those columns, n_words, n_hit, n_items,
    items_sha256, contaminated; with ``spans`` also hits, the (start, end) of hit stretches in words, and items, their
    item_ids. Only texts travel to Python. The index files stay in the shared folder, as the result is read from them."""
    spark = docs.sparkSession
    bound_batches(spark)
    paths = write_indexes(benchmark, f"{shared_dir(spark)}/textloom-windows-{uuid.uuid4().hex}", window)

    @F.arrow_udf(FOUND_SQL)
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from steady(lambda batches: (_judge(x, paths) for x in batches), "indexes")(texts)

    judged = docs.select(*keep, judge(F.col("text")).alias("_found"))
    return judged.select(*keep, *(F.col(f"_found.{f.name}").alias(f.name) for f in list(FOUND)[: len(FOUND) if spans else 5]))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark.select("item_id", "text"))


#: By every window, every pair and every row: for small tables.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS p FROM i WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, k, array_to_string(w[p + 1 : p + k], ' ') AS win FROM s),
g AS (SELECT r, k, w, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM x) AS ks WHERE len(w) >= k),
h AS (SELECT r, p, k, item_id FROM (SELECT r, p, k, array_to_string(w[p + 1 : p + k], ' ') AS win FROM g) AS a JOIN x USING (k, win)),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM h)) GROUP BY r),
n AS (SELECT r, count(DISTINCT coalesce(item_id, '=')) AS n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)
"""
