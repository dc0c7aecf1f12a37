"""One query opN_<name> for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_html, op2_substring, op3_urls, op4_jaccard, op5_decontaminate, op10_licenses
from .op1_html import op1_html_extraction
from .op2_substring import op2_substring_dedup
from .op3_urls import op3_url_filters
from .op4_jaccard import op4_jaccard_join
from .op5_decontaminate import op5_decontamination
from .op6_language import op6_language_id
from .op7_tokens import op7_token_output
from .op8_quality import op8_quality_rules
from .op9_mixing import op9_mixing
from .op10_licenses import op10_license_scans


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, which lies at the top of the repository and imports this subpackage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_substring_dedup,
        op3_url_filters,
        op4_jaccard_join,
        op5_decontamination,
        op6_language_id,
        op7_token_output,
        op8_quality_rules,
        op9_mixing,
        op10_license_scans,
        pipeline,
    )
}
#: Where SQL can express a query; the others are tested against brute force, a round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op1_html_extraction": op1_html.ORACLE,
    "op2_substring_dedup": op2_substring.ORACLE,
    "op3_url_filters": op3_urls.ORACLE,
    "op4_jaccard_join": op4_jaccard.ORACLE,
    "op5_decontamination": op5_decontaminate.ORACLE,
    "op10_license_scans": op10_licenses.ORACLE,
}
