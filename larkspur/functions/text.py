"""Text and token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit("[a-z0-9]+"))


def sample_id(number: Column, turn: Column) -> Column:
    return F.concat_ws("-", number.cast("string"), turn.cast("string"))


def normalise_qid(qid: Column) -> Column:
    return F.replace(qid, F.lit("_"), F.lit("-"))


def last_segment(qid: Column) -> Column:
    return F.substring_index(qid, "-", -1)


def base_id(qid: Column) -> Column:
    """The id without its last segment; without a dash, without its last character."""
    return F.when(F.contains(qid, F.lit("-")), F.regexp_replace(qid, "-[^-]*$", "")).otherwise(F.substring(qid, F.lit(1), F.greatest(F.length(qid) - 1, F.lit(0))))


def extract_numbers(value: Column) -> Column:
    """All digit runs of a text, as strings in order."""
    return F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0))


def split_rewrite(text: Column, most: int = 5) -> Column:
    """A rewrite's distinct sub-queries in order, `most` at most; empty if it has none.

    Quotes and list numbers go (so does the whole part of a decimal); line ends count as commas. With a question mark
    anywhere pieces end at question marks and all get one, else pieces end at commas.
    """
    plain = F.translate(text, '"“”', "")
    plain = F.replace(F.regexp_replace(plain, r"\d+\.\s*", ""), F.lit("\n"), F.lit(", "))
    asked = F.contains(plain, F.lit("?"))
    pieces = F.when(asked, F.split(plain, r"\?,?\s*")).otherwise(F.split(plain, ","))
    pieces = F.filter(F.transform(pieces, strip), lambda p: p != "")
    pieces = F.when(asked, F.transform(pieces, lambda p: F.concat(p, F.lit("?")))).otherwise(pieces)
    return F.slice(F.array_distinct(pieces), 1, most)


def pad_query(ids: Column, length: int) -> Column:
    """The last `length` ids, filled up with zeros on the right."""
    kept = F.when(F.size(ids) > length, F.slice(ids, -length, length)).otherwise(ids)
    return F.concat(kept, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def pad_passage(ids: Column, length: int, left: bool = False) -> Column:
    """The first `length` ids, filled up with zeros on the right (or left)."""
    fill = F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    kept = F.slice(ids, 1, length)
    return F.concat(fill, kept) if left else F.concat(kept, fill)


def attention_mask(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def token_types(length: int, passage: bool) -> Column:
    return F.array_repeat(F.lit(int(passage)), F.lit(length))
