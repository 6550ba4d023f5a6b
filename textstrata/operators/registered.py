"""Operators by name in a session's SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import output
from . import citations, gates, redaction, structure

#: SQL name and function; arguments as in Python.
NAMES = {
    "ts_text_blocks": structure.text_blocks,
    "ts_outline": structure.outline,
    "ts_chunks": structure.structured_chunks,
    "ts_redact": redaction.redact,
    "ts_redacted_slice": redaction.redacted_slice,
    "ts_restore": redaction.restore,
    "ts_citations": citations.citations,
    "ts_included": gates.included,
    "ts_claims": output.claims_of,
    "ts_string_list": output.string_list,
}


def register(spark: SparkSession) -> None:
    """Make the operators callable from the session's SQL; to register them again changes nothing."""
    for name, function in NAMES.items():
        spark.udf.register(name, function.udf())
