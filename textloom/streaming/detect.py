"""Detection over streams. No operator here keeps state: a payload is judged when it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.detect import Options
from ..operators.detection import detect_best
from ..sources.files import read_file_stream


def detected_files(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """(path, modified, length, encoding, chaos, coherence, language, bom) of each file as it comes."""
    found = detect_best(read_file_stream(spark, path), "payload", options)
    return found.select("path", "modified", "length", *(F.col(f"best.{c}").alias(c) for c in ("encoding", "chaos", "coherence", "language", "bom")))


def write_detected(spark: SparkSession, path: str, output: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Appends the above to a Parquet table, once for each file, and ends when no more files are there."""
    return detected_files(spark, path, options).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
