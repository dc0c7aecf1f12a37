"""Files as payloads, in batch or as a stream, and normalised files as a sink."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as D

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, *paths: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """(path, modified, length, payload) of each file; a file is one row, and reading is parallel over files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _named(reader.load(list(paths)))


def read_file_stream(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as they come. Detection is stateless, so its result can be appended."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _named(reader.load(path))


def _named(df: DataFrame) -> DataFrame:
    return df.select("path", F.col("modificationTime").alias("modified"), "length", F.col("content").alias("payload"))


def normalized_path(path: str, encoding: str) -> str:
    """The name with the encoding before its last part: a.b.txt becomes a.b.cp1252.txt."""
    folder, _, name = path.rpartition("/")
    parts = name.split(".")
    parts.insert(-1 if len(parts) > 1 else 1, encoding)
    return (folder + "/" if folder else "") + ".".join(parts)


def sink(folder: str | None = None, replace: bool = False, target: str = "utf_8") -> Callable[[str, D.Match | None], str | None]:
    """A function that writes the text of a file's match in the target encoding and gives the place. Beside the file, or
    into ``folder``; over the file only with ``replace``. Files already in a Unicode encoding and binary ones are left alone: no
    place. A file is written whole under a name of its own and then moved, so a task that is lost or repeated leaves the
    same result."""

    def write(path: str, match: D.Match | None) -> str | None:
        if match is None or match.encoding.startswith("utf"):
            return None
        where = path if replace else normalized_path(path, match.encoding)
        if folder and not replace:
            where = f"{folder.rstrip('/')}/{where.rpartition('/')[2]}"
        fs, name = pafs.FileSystem.from_uri(where) if ":" in where.split("/")[0] else (pafs.LocalFileSystem(), where)
        fs.create_dir(os.path.dirname(name), recursive=True)
        part = f"{name}.part-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write(match.output(target))
        fs.move(part, name)
        return where

    return write


def write_normalized(df: DataFrame, folder: str | None = None, replace: bool = False, target: str = "utf_8", options: D.Options | None = None) -> DataFrame:
    """Writes each file of ``df`` (path, payload) by :func:`sink` and gives (path, encoding, unicode_path)."""
    options, write = options or D.Options(), sink(folder, replace, target)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = D.detect(payload, options)[0] if payload is not None else []
                out.append((path, found[0].encoding if found else None, write(path, found[0] if found else None)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 3, names=["path", "encoding", "unicode_path"])

    return df.select("path", "payload").mapInArrow(rows, "path string, encoding string, unicode_path string")
