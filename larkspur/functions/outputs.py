"""What language models answer, taken apart. A field is null where its pattern is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import strip

# Formats of answers; fixed values.
QUERIES = r"(?s)Queries:\s*(.*)"
RESPONSE_BEFORE_QUERIES = r"(?s)Response:(.*?)Queries:"
REWRITE = r"(?s)Rewrite:\s*(.*?)Response:"
REWRITE_RAW = r"(?s)Rewrite:(.*?)Response:"
REWRITE_LINE = r"(?s)Rewrite:\s*(.*?)\nResponse:"
RESPONSE = r"(?s)Response:\s*(.*)"
PROVENANCE = r"(?s)Provenance:\s*(.*)"
PROVENANCE_LINE = r"(?s)Provenance:\s*(.*?)\nRewrite:"


def found(text: Column, pattern: str) -> Column:
    """Group 1, or null without a match (an empty group is not a missing one)."""
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def _all(**fields: Column) -> Column:
    """A struct of the fields, null if one of them is."""
    missing = F.lit(False)
    for value in fields.values():
        missing = missing | value.isNull()
    return F.when(~missing, F.struct(*[v.alias(k) for k, v in fields.items()]))


def parse_prompt1(text: Column) -> Column:
    return _all(rewrite=strip(found(text, QUERIES)), response=strip(found(text, RESPONSE_BEFORE_QUERIES)))


def parse_prompt2(text: Column) -> Column:
    return _all(rewrite=strip(found(text, REWRITE)), response=strip(found(text, RESPONSE)))


def parse_sar(text: Column) -> Column:
    """Online form: nothing is stripped, the provenance is not looked at."""
    return _all(rewrite=found(text, REWRITE_RAW), response=found(text, RESPONSE))


def parse_sar_batch(text: Column) -> Column:
    """Batch form: all three parts, each on a line of its own."""
    return _all(provenance=strip(found(text, PROVENANCE_LINE)), rewrite=strip(found(text, REWRITE_LINE)), response=strip(found(text, RESPONSE)))


def parse_automatic(text: Column, batch: bool = False) -> Column:
    if batch:
        return _all(rewrite=strip(found(text, REWRITE_LINE)), response=strip(found(text, RESPONSE)))
    return parse_sar(text)


def parse_selection(text: Column, batch: bool = False) -> Column:
    """Online a failure is the text 'None'; in batches it is null, and the row is to be dropped."""
    value = strip(found(text, PROVENANCE))
    return value if batch else F.coalesce(value, F.lit("None"))
