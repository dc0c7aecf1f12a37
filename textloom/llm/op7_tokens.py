"""Token ids of whole documents in Arrow stream files of equal-length sequences.

Documents are dealt out in ranges of doc_id and sorted; each task encodes its documents one after the other, ends each
with the end id, cuts the ids into sequences of SEQUENCE ids, and writes them as one Arrow IPC stream file: record
batches of ``ids`` (fixed_size_list<uint16>, uint32 for vocabularies over 65,536) and ``mask`` (fixed_size_list<bool>, false
where the last sequence is padded). The size is a multiple of 8, so that masks begin at bytes.
Every batch but the last has BATCH sequences and no nulls, so sequence i of a mapped file is a slice of a buffer, without
a copy. Beside it lies ``.docs``, a stream of (doc_id, first, n_tokens) with each document's place in the file.

Files are written under a name of the task's attempt. When all tasks are done, ``manifest.json`` lists the files that
count, in order, with the vocabulary, the end id and the sizes: a folder is whole if it has one, and
:func:`open_tokens` needs nothing else. What lost or repeated attempts left beside them is never read. The folder may be in
any store that pyarrow opens.

The text is split at white space (0x20, 0x09-0x0D), across which this tokenizer never joins. Each slice of a batch is
reduced to its distinct words; a worker encodes those that it doesn't know by the library, many at once, and remembers
words in two generations of REMEMBERED: the older goes when the younger is full, and what is used comes back.
A text in which a special token's own text might reach over white space can't be met, as none of them has any.

Null and empty texts are the end id alone. Documents of one doc_id follow each other by a hash of their text, then the
text; null ids come first. Texts of any length are encoded in pieces, cut at white space. An empty table makes no file and
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import register, steady
from .store import delete, open_store, shared_dir, small_batches
from .words import slices

SEQUENCE, BATCH, END_ID = 2048, 64, 1
#: Words in each generation of a worker's memory.
REMEMBERED = 250_000
#: Words that are encoded in one go, and bytes of texts.
WORDS_AT_ONCE, PIECE = 64, 4 << 20
#: Letters of ASCII and Latin-1, then marks of ASCII but the apostrophe.
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"

_encoders: dict = {}


def plain_tokenizer(path: str):
    """The tokenizer without its normalizer and its pattern, for words that these leave alone but for their case; None
    if it isn't made of NFC, lower case, a pattern that takes runs of letters and runs of marks whole, and bytes."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    normal = [x["type"] for x in (config["normalizer"] or {}).get("normalizers", [])]
    pre = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
    pattern = pre[0].get("pattern", {}).get("Regex", "") if pre else ""
    runs = {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= set(pattern.split("|"))
    if normal != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"] or not runs:
        return None
    plain = Tokenizer.from_file(path)
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return plain


def bytes_of(strings: pa.Array) -> list[bytes]:
    return strings.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of words (bytes) as packed little-endian integers, and of texts as arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), plain_tokenizer(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        if self.plain:
            suffix = self.plain.model.end_of_word_suffix
            vocabulary = self.plain.get_vocab()
            self.is_last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.is_last[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def words(self, words: list[bytes], plain: bool) -> list[bytes]:
        """The ids of each word; the words differ. ``plain``: they are letters in lower case, or marks, as PLAIN has them."""
        found = list(map(self.young.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            for i, x in zip(missing, map(self.old.get, map(words.__getitem__, missing)), strict=True):
                found[i] = x
            new = [i for i in missing if found[i] is None]
            for i, x in zip(new, (self._plain if plain else self._any)([words[i] for i in new]), strict=True):
                found[i] = x
            self.young.update((words[i], found[i]) for i in missing)
            if len(self.young) > REMEMBERED:
                self.old, self.young = self.young, {}
        return found

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """A token that ends a word says so by its suffix."""
        every: list[int] = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            every += self.plain.encode(b" ".join(words[at : at + WORDS_AT_ONCE]).decode(), add_special_tokens=False).ids
        ids = np.array(every, self.kind)
        return self._cut(ids, np.concatenate([[0], np.flatnonzero(self.is_last[ids]) + 1]), len(words))

    def _any(self, words: list[bytes]) -> list[bytes]:
        """Tokens belong to the word in which they begin."""
        out: list[bytes] = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = [w.decode("utf-8", "replace") for w in words[at : at + WORDS_AT_ONCE]]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begins = list(accumulate((len(w) + 1 for w in some), initial=0))
            out += self._cut(np.array(got.ids, self.kind), np.searchsorted([x[0] for x in got.offsets], begins), len(some))
        return out

    def _cut(self, ids: np.ndarray, edges: np.ndarray, n: int) -> list[bytes]:
        if len(edges) != n + 1:
            raise AssertionError("words and tokens don't match")
        packed, edges = ids.tobytes(), (edges * self.kind.itemsize).tolist()
        return [packed[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _gather(self, known: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words in the order of ``which``, and how many each gives."""
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        begin, n = np.cumsum(size) - size, size[which]
        ends = np.cumsum(n)
        return np.frombuffer(b"".join(known), self.kind)[np.repeat(begin[which] - ends + n, n) + np.arange(n.sum())], n

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has."""
        parts = pc.extract_regex(words, PLAIN) if self.plain else pa.nulls(len(words), pa.struct([("letters", words.type), ("marks", words.type)]))
        others = bytes_of(words.filter(parts.is_null()))
        known = self.words(others, plain=False)
        plain = np.flatnonzero(parts.is_valid().to_numpy(zero_copy_only=False))
        which = np.full((len(words), 2), len(known))
        which[np.flatnonzero(parts.is_null().to_numpy(zero_copy_only=False)), 0] = np.arange(len(others))
        known.append(b"")
        for k, column in enumerate((pc.utf8_lower(parts.field(0)), parts.field(1)) if len(plain) else ()):
            coded = column.take(pa.array(plain)).dictionary_encode()
            own = bytes_of(coded.dictionary)
            which[plain, k] = coded.indices.to_numpy() + len(known)
            known += self._with_empty(own)
        ids, n = self._gather(known, which.ravel())
        return ids, n[::2] + n[1::2]

    def _with_empty(self, words: list[bytes]) -> list[bytes]:
        if b"" not in words:
            return self.words(words, plain=True)
        at = words.index(b"")
        found = self.words(words[:at] + words[at + 1 :], plain=True)
        return [*found[:at], b"", *found[at:]]

    def texts(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each with ``end``; and how many each has."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        ids, size = self._distinct(coded.dictionary)
        ids = np.concatenate([ids, np.frombuffer(end, self.kind)])
        size = np.append(size, len(end) // self.kind.itemsize)
        ends = split.offsets.to_numpy()[1:]
        word = np.insert(coded.indices.to_numpy(), ends, len(size) - 1)
        begin, n = np.cumsum(size) - size, size[word]
        upto = np.cumsum(n)
        return ids[np.repeat(begin[word] - upto + n, n) + np.arange(n.sum())], np.diff(upto[ends + np.arange(len(ends))], prepend=0)


def pieces(texts: pa.Array) -> Iterator[tuple[pa.Array, bool]]:
    """Slices of about PIECE bytes; a longer text in pieces cut at white space. With whether the last text goes on."""
    for low, high, data, offsets in slices(texts, PIECE):
        if high - low > 1 or len(data) <= 2 * PIECE:
            yield pa.Array.from_buffers(pa.large_string(), high - low, [None, pa.py_buffer(offsets), pa.py_buffer(data)]), False
            continue
        text, at = data.tobytes(), 0
        while at < len(text):
            space = SPACE.search(text, at + PIECE)
            cut = space.start() if space else len(text)
            yield pa.array([text[at:cut]], pa.binary()).cast(pa.string()), cut < len(text)
            at = cut


SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _forget() -> None:
    for e in _encoders.values():
        e.young, e.old = {}, {}


register("words", _forget)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _schema(size: int, kind: np.dtype) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.from_numpy_dtype(kind), size), nullable=False), pa.field("mask", pa.list_(pa.bool_(), size), nullable=False)])


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them in batches; holds one batch."""

    def __init__(self, sink, size: int, kind: np.dtype):
        if size % 8:
            raise ValueError("sequences have a multiple of 8 ids")
        self.size, self.schema = size, _schema(size, kind)
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.size * BATCH:
            self._write(self.n // (self.size * BATCH) * BATCH)

    def _write(self, sequences: int) -> None:
        every = self.held[0] if len(self.held) == 1 else np.concatenate(self.held)
        used = every[: sequences * self.size]
        for at in range(0, len(used), self.size * BATCH):
            part = used[at : at + self.size * BATCH]
            self._batch(part, np.ones(len(part), bool))
        rest = every[sequences * self.size :]
        self.held, self.n = [rest], len(rest)

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.size) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n:
            ids = np.concatenate(self.held)
            room = -len(ids) % self.size
            self._batch(np.pad(ids, (0, room)), np.pad(np.ones(len(ids), bool), (0, room)))
        self.out.close()


DOCS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, size: int = SEQUENCE, end_id: int = END_ID) -> list[tuple[int, str, int]]:
    """Writes the files and their manifest; gives (number, path, ids) of each, in order of doc_id."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context, fs, writer = encoder(vocabulary), TaskContext.get(), None, None
        end = np.array([end_id], encode.kind).tobytes()
        first = 0
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
                fs, path = open_store(name)
                fs.create_dir(os.path.dirname(path), recursive=True)
                sink, index = fs.open_output_stream(path + ".arrows"), fs.open_output_stream(path + ".docs")
                writer, places = SequenceWriter(sink, size, encode.kind), pa.ipc.new_stream(index, DOCS)
            row, begun = 0, 0
            for texts, goes_on in pieces(b.column(1)):
                ids, counts = encode.texts(texts, b"" if goes_on else end)
                writer.add(ids)
                counts[0] += begun
                if goes_on:
                    begun = int(counts[0])
                    continue
                begun, ends = 0, first + np.cumsum(counts)
                places.write_batch(pa.RecordBatch.from_arrays([b.column(0).slice(row, len(counts)), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64())], schema=DOCS))
                row, first = row + len(counts), int(ends[-1])
        if writer is not None:
            writer.close()
            places.close()
            sink.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int64()), pa.array([name]), pa.array([first], pa.int64())], names=["part", "path", "n"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    with small_batches(docs.sparkSession):
        parts = sorted(tuple(r) for r in dealt.mapInArrow(steady(write, "words"), "part bigint, path string, n bigint").collect())
    with open(vocabulary, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    files = [{"name": path.rsplit("/", 1)[1], "ids": n} for _, path, n in parts]
    fs, path = open_store(folder)
    fs.create_dir(path, recursive=True)
    # written beside its place and moved there: a manifest is whole or not there
    with fs.open_output_stream(f"{path}/{MANIFEST}.part") as out:
        out.write(json.dumps({"vocabulary": os.path.basename(vocabulary), "vocabulary_sha256": digest, "end_id": end_id, "sequence": size, "files": files}, indent=1).encode())
    fs.move(f"{path}/{MANIFEST}.part", f"{path}/{MANIFEST}")
    return parts


MANIFEST = "manifest.json"


def manifest(folder: str) -> dict:
    fs, path = open_store(folder)
    with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


def open_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents of a folder that :func:`write_tokens` has finished."""
    return read_tokens(spark, [(i, f"{folder.rstrip('/')}/{x['name']}", x["ids"]) for i, x in enumerate(manifest(folder)["files"])])


class TokenFile:
    """A written file, mapped where the store allows it: ``[i]`` is the ids of sequence i, a view of the file, and its mask,
    an Arrow array that is one too."""

    def __init__(self, path: str):
        fs, name = open_store(path)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.batches = list(pa.ipc.open_stream(pa.memory_map(name + ".arrows") if local else fs.open_input_file(name + ".arrows")))
        self.docs = pa.ipc.open_stream(fs.open_input_stream(name + ".docs"))
        self.full = self.batches[0].num_rows if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        b, at = self.batches[i // self.full], i % self.full
        ids, mask = (b.column(k) for k in (0, 1))
        size = ids.type.list_size
        own, shown = (x.values.slice((x.offset + at) * size, size) for x in (ids, mask))
        return own.to_numpy(zero_copy_only=True), shown

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from a place in the file on."""
        out = []
        size = self.batches[0].column(0).type.list_size
        while n:
            own, _ = self[first // size]
            part = own[first % size : first % size + n]
            out.append(part)
            first, n = first + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, np.uint16)])


def read_tokens(spark: SparkSession, parts: list[tuple[int, str, int]]) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of each document."""
    starts = [0, *accumulate(n for _, _, n in parts)]
    listed = [(path, start) for (_, path, _), start in zip(parts, starts, strict=False)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                for docs in file.docs:
                    first, n = (docs.column(k).to_numpy() for k in (1, 2))
                    crc = [zlib.crc32(file.ids(int(f), int(k)).astype("<u4")) for f, k in zip(first, n, strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(first + start, pa.int64()), docs.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(listed, "path string, start bigint").repartition(len(parts), "path").mapInArrow(steady(read), schema)


def tokenized(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) to ``folder`` (a new one of the shared folder if None) and reads it back."""
    spark = docs.sparkSession
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    folder = folder or f"{shared_dir(spark)}/textloom-tokens-{uuid.uuid4().hex}"
    try:
        return read_tokens(spark, write_tokens(docs, folder, vocabulary))
    except BaseException:
        delete(spark, folder)
        raise


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
