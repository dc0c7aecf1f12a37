"""The corpus pipeline: language, near duplicates, contamination, mixture and token files, one operator a stage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last give the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.llm import op4_jaccard, op5_decontaminate, op6_language, op7_tokens, op9_mixing
from textloom.llm.store import Scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates share 80 of 100 windows of five words, or more; op4's own query has other ones by its contract.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which no language is recognised: no text, or no letter."""
    prototypes = op6_language.learn(docs, ~op6_language.held_out(F.col("doc_id")))
    return op6_language.predict(docs.select(*COLUMNS), prototypes).where(F.col("lang_pred") != op6_language.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that of the smallest doc_id. Rows are told apart by doc_id and text, so a
    doc_id that is there with different texts loses those that are copies and no others."""
    return op4_jaccard.first_of_components(docs.select(*COLUMNS), SHINGLE, NUMERATOR, DENOMINATOR)


def _repeated_ids(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    judged = op5_decontaminate.contaminated(docs, benchmark, keep=COLUMNS)
    return judged.where("not contaminated").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; none that it doesn't."""
    own = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("text"))
    mixed = op9_mixing.mixed(docs.select("doc_id", "text", "source"))
    # rows that are alike in id, text and source are told apart by a number; any of them may stand for another
    alike = W.partitionBy("doc_id", "row_key", "source").orderBy("row_key")
    place = F.row_number().over(alike) if _repeated_ids(docs) else F.lit(1)
    taken = mixed.withColumn("place", place).where("copies > 0").select(*(F.col(c).alias(f"m_{c}") for c in ("doc_id", "row_key", "source", "place", "copies")))
    same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in ("doc_id", "source")] + [F.col(c) == F.col(f"m_{c}") for c in ("row_key", "place")]
    joined = own.withColumn("place", place).join(taken, same[0] & same[1] & same[2] & same[3])
    return joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("m_copies").cast("int"))).alias("copy")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place, length and checksum in the token files."""
    return op7_tokens.tokenized(docs.select("doc_id", "text"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL can express neither the learned language profiles nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scope(spark) as s:
        for _, stage in STAGES[:-1]:
            docs = s.table(stage(spark, docs, sf_dir))
        return s.keep(STAGES[-1][1](spark, docs, sf_dir))
