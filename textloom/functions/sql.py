"""Functions for columns and for SQL: Arrow-batched where the meaning is sequential, Spark's own otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.functions import pandas_udf, udtf

from . import characters as C
from . import coherence as K
from . import detect as D
from . import mess as M
from . import tables as T

# Types and not their names: those can be read only where a session is.
RATIOS = ty.ArrayType(ty.StructType([ty.StructField("language", ty.StringType()), ty.StructField("ratio", ty.DoubleType())]))
MATCH = ty.StructType([ty.StructField(n, t()) for n, t in (("rank", ty.IntegerType), ("encoding", ty.StringType), ("chaos", ty.DoubleType), ("coherence", ty.DoubleType), ("bom", ty.BooleanType), ("language", ty.StringType))])


@pandas_udf(ty.DoubleType())
def mess_ratio(text: pd.Series) -> pd.Series:
    """Noise of each text, as the detector reads it (limit 0.2)."""
    return text.map(lambda x: None if x is None else M.mess_ratio(x))


@pandas_udf(ty.ArrayType(ty.DoubleType()))
def mess_details(text: pd.Series) -> pd.Series:
    """The ten detectors' ratios of each whole text, in the order of ``mess.NAMES``."""
    return text.map(lambda x: None if x is None else M.mess_details(x, float("inf"))[1])


@pandas_udf(RATIOS)
def coherence_ratio(text: pd.Series) -> pd.Series:
    """The languages each text agrees with, the best first."""
    return text.map(lambda x: None if x is None else [{"language": k, "ratio": v} for k, v in K.coherence_ratio(x)])


@pandas_udf(ty.ArrayType(ty.StringType()))
def alphabets(text: pd.Series) -> pd.Series:
    """The sorted names of the Unicode ranges that each text has characters of."""
    names, _ = T.ranges()

    def of(x):
        return None if x is None else sorted(names[i] for i in np.unique(C.range_indexes(C.codes_of(x))) if i < len(names))

    return text.map(of)


@pandas_udf(ty.StringType())
def detect_encoding(payload: pd.Series) -> pd.Series:
    """The best encoding of each payload, null for binary ones."""

    def of(x):
        found = None if x is None else D.detect(bytes(x))[0]
        return found[0].encoding if found else None

    return payload.map(of)


@pandas_udf(ty.BooleanType())
def is_binary(payload: pd.Series) -> pd.Series:
    return payload.map(lambda x: None if x is None else D.is_binary(bytes(x)))


@pandas_udf(ty.StringType())
def decode_best(payload: pd.Series) -> pd.Series:
    """Each payload's text under its best encoding."""

    def of(x):
        found = None if x is None else D.detect(bytes(x))[0]
        return found[0].decoded() if found else None

    return payload.map(of)


@udtf(returnType=MATCH)
class CharsetMatches:
    """SELECT ... FROM t, LATERAL charset_matches(t.payload)"""

    def eval(self, payload: bytes):
        if payload is not None:
            for i, m in enumerate(D.detect(bytes(payload))[0]):
                yield i, m.encoding, m.chaos, m.coherence, m.bom, m.language


def text_fingerprint(text: Column | str) -> Column:
    """Equal for equal texts."""
    return F.xxhash64(text)


def register(spark: SparkSession) -> None:
    """Name the functions in the session's SQL."""
    for name in ("mess_ratio", "mess_details", "coherence_ratio", "detect_encoding", "is_binary", "decode_best", "alphabets"):
        spark.udf.register(name, globals()[name])
    spark.udtf.register("charset_matches", CharsetMatches)
