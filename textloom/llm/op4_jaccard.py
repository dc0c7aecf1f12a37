"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

Tokens are distinct 3-word shingles. Two documents link when 100 * intersection >= 90 * union.

1. Equal word sequences are gathered by digest; one text of each enters the join, and its copies share its component.
2. The document frequency of every token is counted over all runs by merging sorted key lists; a run gets back the
   class of each of its tokens (the logarithm of its frequency). Tokens are ordered by class, then hash. Key lists hold
   shortened hashes: a clash can only make a token look more frequent, for all documents alike, so order and result
   stay right.
3. A document of n tokens needs an overlap of o = ceil(90 n / 100) with any partner, so partners share a token of
   the first n - o + 1 (the prefix). Tokens that occur once match nothing. Rare tokens of the prefix are indexed singly.
   If frequent tokens are in it, the prefix is extended to n - o + g + 1 tokens, of which partners without a common
   rare token share g + 1 frequent ones; these fall into g hash classes, so two of them share a class, and the pairs of
   frequent tokens of one class are indexed. g grows with n, so a document has about n / 5 such pairs.
4. Keys deal out candidates by rounds, and the shingles of the texts, word by word, verify them. Before that, sizes,
   tokens that no other text has and a parity sketch of the rest bound the overlap: of 512 hash classes, those that
   hold an odd number of these tokens of one text and an even one of the other each hold a token that isn't shared.
   The first round compares one text of each key, that of the fewest unshared tokens, with the others. Then links are
   contracted to components, and only pairs of different components are compared: texts outside their key's largest
   component with all of the key, in slices while that would be too much at once. A pair that shares many keys is made
   at the smallest of them; only if that isn't among the first of both texts, at others too. A group of near copies so
   costs a few comparisons for each copy and not all pairs, while no component that all pairs would connect is missed.

Null and empty texts have no tokens and link with nothing; their component is their own doc_id. Texts of one or two
words have their whole sequence as one token. Repeated rows and doc_ids are gathered by text. A null doc_id gets the
smallest id of its component, null if there is none. Extra columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs as R
from .components import components
from .memory import steady
from .store import Scope
from .words import NONSPACE, Words, window_hashes, words

SHINGLE, NUMERATOR, DENOMINATOR = 3, 90, 100
#: A token of frequency 2**RARE and more is frequent.
RARE = 5
#: Bits of a token's hash beside those of the bucket.
SHORT = 28


def token_sets(w: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct tokens of each document, one after the other, and where each document's begin."""
    h, n = w.hashes(), np.diff(w.first)
    hashes, at = window_hashes(h, w.doc, shingle)
    ends = np.searchsorted(at, w.first)
    sets = [np.unique(hashes[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    for size in range(1, shingle):
        if (n == size).any():
            short, where = window_hashes(h, w.doc, size)
            whole = dict(zip(where.tolist(), short, strict=True))
            for i in np.flatnonzero(n == size):
                sets[i] = np.array([whole[w.first[i]]], np.uint64)
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def exact_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as numbers, the same only for the same words. A text of fewer words has
    one that no other text has: texts of equal words are one text here."""
    numbers: dict[bytes, int] = {}
    coded = []
    for x in texts:
        found = x.split()
        for w in set(found).difference(numbers):
            numbers[w] = len(numbers)
        coded.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
    every = np.concatenate([*coded, np.zeros(0, np.int64)])
    first = np.concatenate([[0], np.cumsum([len(x) for x in coded])])
    base = max(1, len(numbers))
    code, most = every, base
    for i in range(1, shingle):
        if most > (1 << 62) // base:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            most = len(code)
        code, most = code[:-1] * base + every[i:], most * base
    return [np.unique(code[a : b - shingle + 1]) if b - a >= shingle else np.array([-1 - i] * (b > a), np.int64) for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))]


def _packed(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as compressed differences, byte by byte."""
    gaps = np.diff(keys, prepend=np.uint32(0)).astype(np.uint32)
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


class _Classes(R.Merge):
    """The logarithm of the frequency of each token over all runs. more: how often it is in its run, 255 at most, or in
    many runs together, in 32 bits."""

    def _counted(self, rows: list[dict]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        each = [_unpacked(r["keys"]) for r in rows]
        keys, place = np.unique(np.concatenate(each), return_inverse=True)
        counts = [zstandard.decompress(r["more"]) for r in rows]
        counts = np.concatenate([np.frombuffer(c, np.uint8 if len(c) == len(e) else np.uint32) for c, e in zip(counts, each, strict=True)])
        return [len(e) for e in each], keys, place, np.bincount(place, weights=counts)

    def found(self, rows: list[dict]) -> list[bytes]:
        sizes, _, place, total = self._counted(rows)
        classes = np.minimum(np.log2(total).astype(np.uint8), 15)[place]
        return [zstandard.compress(x.tobytes(), 1) for x in np.split(classes, np.cumsum(sizes)[:-1])]

    def gathered(self, rows: list[dict]) -> tuple[bytes, bytes]:
        _, keys, _, total = self._counted(rows)
        return _packed(keys), zstandard.compress(np.minimum(total, 1 << 20).astype(np.uint32).tobytes(), 1)

    def dealt(self, whole: dict, found: bytes, rows: list[dict]) -> list[bytes]:
        every, classes = _unpacked(whole["keys"]), np.frombuffer(zstandard.decompress(found), np.uint8)
        return [zstandard.compress(classes[np.searchsorted(every, _unpacked(r["keys"]))].tobytes(), 1) for r in rows]


def _combinations(tokens: np.ndarray, n: int, level: int) -> Iterator[np.ndarray]:
    """Keys of the pairs of tokens (sorted by order) that share one of g hash classes."""
    g = 1 << max(0, level - 3)
    of = (tokens >> np.uint64(17)) % np.uint64(g)
    order = np.argsort(of, kind="stable")
    of, tokens = of[order], tokens[order]
    for gap in range(1, len(tokens)):
        same = np.flatnonzero(of[gap:] == of[:-gap])
        if not len(same):
            break
        a, b = tokens[same], tokens[same + gap]
        yield (np.minimum(a, b) * np.uint64(0x9E3779B97F4A7C15) ^ np.maximum(a, b)) * np.uint64(2 * level + 3) + np.uint64(level)


def index_keys(tokens: np.ndarray, classes: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """The keys under which one document's set is indexed."""
    n = len(tokens)
    most = n + (-numerator * n) // denominator  # n - ceil(t n)
    prefix = most + 1
    if np.count_nonzero(classes == 0) >= prefix:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, classes))
    tokens, classes = tokens[order], classes[order]
    rare = int(np.searchsorted(classes, RARE))
    out = [tokens[int(np.searchsorted(classes, 1)) : min(rare, prefix)]]
    if rare < prefix:
        if n == 1:
            out.append(tokens)
        else:
            # partners may be of the next level: sizes differ by the ratio at most
            for level in {n.bit_length() - 1, (n * numerator // denominator).bit_length() - 1, (n * denominator // numerator + 1).bit_length() - 1}:
                if level >= 1:
                    g = 1 << max(0, level - 3)
                    out += _combinations(tokens[rare : most + g + 1], n, level)
    return np.unique(np.concatenate(out))


TEXT = "digest binary, uid bigint, id bigint, copies bigint, n bigint, keys array<bigint>, z binary, alone bigint, sketch array<bigint>"
#: Longs of a parity sketch.
SKETCH = 8
#: So many of a text's keys tell at which one a pair is made.
FIRST = 8
#: Comparisons for each posting that one round may make.
MOST_COMPARISONS = 1000


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """For each of 64 * SKETCH hash classes, whether it holds an odd number of the distinct tokens."""
    odd = np.bincount(((tokens * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _indexed(scope: Scope, table: DataFrame, shingle: int, numerator: int, denominator: int) -> DataFrame:
    """Each text of the runs with its number of tokens; where any key is left, with its keys and the text."""
    size, n_runs = table.agg(F.sum("size"), F.count(F.lit(1))).first()
    buckets = R.buckets_for(size or 0)
    bits = buckets.bit_length() - 1
    shift, mask = np.uint64(64 - bits - SHORT), np.uint64((1 << SHORT) - 1)

    def pieces(batches):
        for row in R.each_run(batches):
            run = R.Run(row)
            tokens, _ = token_sets(words(run.data, run.offsets, NONSPACE), shingle)
            keys, counts = np.unique(tokens >> shift, return_counts=True)
            edges = R.cut(keys << shift, buckets)
            full = np.flatnonzero(np.diff(edges))
            low, counts = (keys & mask).astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([row["run_id"]] * len(full), pa.int64()), pa.array([_packed(low[edges[i] : edges[i + 1]]) for i in full], pa.binary()), pa.array([zstandard.compress(counts[edges[i] : edges[i + 1]].tobytes(), 1) for i in full], pa.binary())],
                names=["bucket", "run_id", "keys", "more"],
            )

    def texts(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for row in R.each_run(batches):
            run = R.Run(row)
            tokens, first = token_sets(words(run.data, run.offsets, NONSPACE), shingle)
            short, place = np.unique(tokens >> shift, return_inverse=True)
            found = np.concatenate([np.frombuffer(zstandard.decompress(x["found"]), np.uint8) for x in row["got"]]) if row["got"] else np.zeros(len(short), np.uint8)
            classes = found[place]
            n = np.diff(first)
            alone = np.concatenate([[0], np.cumsum(classes == 0)])
            alone = alone[first[1:]] - alone[first[:-1]]
            keys, z, sketch = ([None] * len(n) for _ in range(3))
            for i in np.flatnonzero(alone < n + (-numerator * n) // denominator + 1).tolist():
                got = index_keys(tokens[first[i] : first[i + 1]], classes[first[i] : first[i + 1]], numerator, denominator)
                if len(got):
                    own, shared = tokens[first[i] : first[i + 1]], classes[first[i] : first[i + 1]] > 0
                    keys[i], z[i], sketch[i] = got.view(np.int64), pack(run.text(i)), parity_sketch(own[shared])
            uid = (row["run_id"] << 16) + np.arange(len(n))
            ids = pa.array(run.ids, pa.int64(), mask=run.ids == R.NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(run.digests, pa.binary()), pa.array(uid, pa.int64()), ids, pa.array(run.copies, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(z, pa.binary()), pa.array(alone, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))], names=["digest", "uid", "id", "copies", "n", "keys", "z", "alone", "sketch"])

    counted = R.merge(scope, table.mapInArrow(steady(pieces), R.PIECE), _Classes(), n_runs)
    return scope.table(R.returned(counted, table.drop("size")).mapInArrow(steady(texts), TEXT))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, numerator: int, denominator: int, parts: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts link."""

    def check(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256).to_pydict()
                # each text once
                place: dict[int, int] = {}
                kept: list[bytes] = []
                for uid, z in zip(some["a"] + some["b"], some["za"] + some["zb"], strict=True):
                    if uid not in place:
                        place[uid] = len(kept)
                        kept.append(unpack(z))
                sets = exact_sets(kept, shingle)
                ok = []
                for x, y in zip(some["a"], some["b"], strict=True):
                    p, q = sets[place[x]], sets[place[y]]
                    if len(p) > len(q):
                        p, q = q, p
                    where = np.searchsorted(q, p)
                    where[where == len(q)] = 0
                    both = int(np.count_nonzero(q[where] == p)) if len(p) else 0
                    ok.append(both > 0 and denominator * both >= numerator * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([pa.array([v for v, o in zip(some[k], ok, strict=True) if o], pa.int64()) for k in ("a", "b")], names=["a", "b"])

    z = texts.select(F.col("uid"), F.col("z"))
    full = pairs.join(z.select(F.col("uid").alias("a"), F.col("z").alias("za")), "a").join(z.select(F.col("uid").alias("b"), F.col("z").alias("zb")), "b")
    return full.select("a", "b", "za", "zb").coalesce(parts).mapInArrow(steady(check), "a bigint, b bigint")


def _met(texts: DataFrame, pivots: DataFrame, near: Column) -> DataFrame:
    """The pairs (a, b) of texts and pivots of different components that share a key and may link. Each is made at its
    smallest key, which is never passed over: what both have among their first keys isn't smaller."""
    here = F.coalesce(F.array_min(F.array_intersect("first", "pfirst")), F.col("key")) >= F.col("key")
    pairs = texts.join(pivots, (F.col("key") == F.col("pkey")) & (F.col("component") != F.col("pc")) & near & here)
    return pairs.select(F.least("uid", "p").alias("a"), F.greatest("uid", "p").alias("b"))


def _links(scope: Scope, texts: DataFrame, shingle: int, numerator: int, denominator: int) -> DataFrame:
    """(node, component) of all texts that link with another."""
    listed = texts.where(F.col("keys").isNotNull())
    keys, of = listed.agg(F.sum(F.size("keys")), F.count(F.lit(1))).first()
    # tasks by the rows there are: each key is a row of under 100 bytes, each text some KB to verify
    parts, checks = 1 + (keys or 0) // 100_000, max(6, 1 + of // 500)
    marks = [f"s{i}" for i in range(SKETCH)]
    own = listed.select("uid", "n", "keys", "alone", *(F.get("sketch", F.lit(i)).alias(x) for i, x in enumerate(marks)))
    each = own.select("uid", "n", "alone", *marks, F.explode("keys").alias("key"))
    sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("alone", "uid"))["uid"].alias("lead")).where("size > 1")
    postings = scope.table(each.join(sizes, "key"), parts)
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"p{x}"))) for x in marks), F.lit(0))
    # tokens that occur once are in no other text; the sketch is of the others
    apart = apart + F.col("alone") + F.col("palone")
    near = F.expr(f"{denominator} * least(n, pn) >= {numerator} * greatest(n, pn)") & (apart * (denominator + numerator) <= (denominator - numerator) * (F.col("n") + F.col("pn")))
    other = [F.col("n").alias("pn"), F.col("alone").alias("palone"), *(F.col(x).alias(f"p{x}") for x in marks)]
    pairs = postings.where("uid <> lead").select("uid", "n", "alone", *marks, "lead").distinct().join(own.select(F.col("uid").alias("lead"), *other), "lead").where(near).select(F.least("lead", "uid").alias("a"), F.greatest("lead", "uid").alias("b")).distinct()
    edges = scope.table(_verified(pairs, listed, shingle, numerator, denominator, checks))
    groups = components(scope, edges, parts)
    firsts = own.select("uid", F.slice(F.array_sort("keys"), 1, FIRST).alias("first"))
    now = postings.join(groups.select(F.col("node").alias("uid"), "component"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    shares = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("share")).groupBy("key").agg(F.max_by("component", F.struct("share", "component")).alias("main"), F.max("share").alias("share"), F.sum("share").alias("all"))
    open_ = scope.table(now.join(shares.where("share < all"), "key").join(firsts, "uid"), parts)
    # every pair of two components of a key has a text outside the key's main component
    compared, rows = open_.agg(F.sum(F.when(F.col("component") != F.col("main"), F.col("size"))), F.count(F.lit(1))).first()
    slices = 1 + (compared or 0) // (MOST_COMPARISONS * max(1, rows))
    for i in range(slices if rows else 0):
        pivots = open_.where(F.col("component") != F.col("main")).where(F.pmod(F.xxhash64("uid"), F.lit(slices)) == i).select(F.col("key").alias("pkey"), F.col("uid").alias("p"), F.col("component").alias("pc"), F.col("first").alias("pfirst"), *other)
        found = scope.table(_verified(_met(open_, pivots, near).distinct(), listed, shingle, numerator, denominator, checks))
        if not found.isEmpty():
            groups = components(scope, groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found), parts)
            if i + 1 < slices:
                latest = groups.select(F.col("node").alias("uid"), F.col("component").alias("latest"))
                open_ = scope.table(open_.join(latest, "uid", "left").withColumn("component", F.coalesce("latest", "component")).drop("latest"), parts)
    return groups


def _labelled(s: Scope, docs: DataFrame, shingle: int, numerator: int, denominator: int) -> DataFrame:
    """Each distinct text: digest, its smallest id, copies, n shingles, component, the smallest id of that, and whether the text
    leads it: of those with the smallest id, the first by digest."""
    if not 2 * numerator > denominator:
        raise ValueError("the similarity must be over one half")
    table = s.table(R.runs(docs, lower=True))
    texts = _indexed(s, table, shingle, numerator, denominator)
    groups = _links(s, texts, shingle, numerator, denominator)
    labelled = texts.select("digest", "uid", "id", "copies", "n").join(groups.select(F.col("node").alias("uid"), "component"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest"))
    least = labelled.groupBy("component").agg(first["id"].alias("component_id"), first["digest"].alias("lead"))
    return s.table(labelled.join(least, "component").select("digest", "id", "copies", "n", "component_id", (F.col("digest") == F.col("lead")).alias("leads")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    with Scope(docs.sparkSession) as s:
        labelled = _labelled(s, docs, shingle, numerator, denominator).select("digest", "copies", "n", "component_id")
        out = R.with_labels(R.members(docs, lower=True, texts=False), labelled)
        return s.keep(out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce(F.when(F.col("n").isNotNull(), F.col("component_id")), F.col("doc_id")).alias("component_id")))


def first_of_components(docs: DataFrame, shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) without the near duplicates: of each component the row of the
    smallest doc_id stays (null ids last), of several such rows the first by text. Texts without words link with nothing
    and stay; rows alike in doc_id and text are one."""
    key = F.xxhash64("text")
    with Scope(docs.sparkSession) as s:
        labelled = _labelled(s, docs, shingle, numerator, denominator).where("n > 0")
        every = R.members(docs, lower=True, texts=False, key=key).where("n_words > 0")
        rows = s.table(R.with_labels(every, labelled.select("digest", "copies", "id", "leads")))
        # the rows that may stay: few of a text, however many copies it has
        own = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("id"))
        first_rows = rows.where(own)
        # texts that differ in case or white space alone share a digest
        later = first_rows.join(first_rows.groupBy("digest").agg(F.min("key").alias("first")), "digest").where("key <> first")
        both = rows.where(~F.coalesce(own, F.lit(False))).select("doc_id", "key").unionByName(later.select("doc_id", "key"))
        gone = s.keep(both.select(F.col("doc_id").alias("_gone"), F.col("key").alias("_key")).distinct())
        repeated = not docs.select("doc_id", key.alias("key")).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    # never broadcast: what goes grows with the input
    kept = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_gone")) & (key == F.col("_key")), "left_anti")
    if repeated:
        kept = kept.withColumn("_key", key).dropDuplicates(["doc_id", "_key"]).drop("_key")
    return kept


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: By every window, every pair and every row: for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT array_to_string(w, ' ') AS text, min(doc_id) AS id, any_value(w) AS w FROM d GROUP BY 1),
e AS (SELECT id, w, unnest(range(0, greatest(1, len(w) - 2))) AS p FROM t WHERE len(w) > 0),
g AS (SELECT DISTINCT id, array_to_string(w[p + 1 : p + 3], ' ') AS shingle FROM e),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM g AS a JOIN g AS b ON a.shingle = b.shingle AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n AS x ON x.id = a JOIN n AS y ON y.id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a AS id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN len(d.w) = 0 THEN doc_id ELSE least(t.id, coalesce(m.least, t.id)) END AS component_id
FROM d JOIN t ON t.text = array_to_string(d.w, ' ') LEFT JOIN n ON n.id = t.id LEFT JOIN m ON m.id = t.id
"""
