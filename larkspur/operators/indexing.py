"""Preparing a collection: shards, dense offsets, fixed-width token rows and their checks."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkspur.functions.text import pad_passage

ROWS_PER_RANGE = 200_000
MOST_RANGES = 8192


def row_index(rows: DataFrame, order: str, *ties: str, name: str = "row_no", per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """`rows` with their place (from 0) by a numeric column, then by `ties`.

    Rows are dealt by ranges between quantiles of the column (literals, so every evaluation deals alike), placed inside
    their range by a window, and moved up by the rows of the ranges before; no task sees more than about a range. There
    are at most MOST_RANGES of them: beyond, ranges grow and their sorts spill. A row finds its range in two short steps.
    """
    n = rows.count()
    ranges = min(MOST_RANGES, max(1, math.ceil(n / per_range)))
    cuts = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else []
    dealt = rows.withColumn("_range", _range_of(F.col(order), sorted(set(cuts or []))))
    counts = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()} if ranges > 1 else {}
    before = list(accumulate((counts.get(i, 0) for i in range(ranges)), initial=0))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order, *ties)) - 1
    return dealt.withColumn(name, (inside + F.get(F.array(*map(F.lit, before)), F.col("_range"))).cast("long")).drop("_range")


def _range_of(value: Column, edges: list[float]) -> Column:
    """How many of the sorted edges are below a value: first by pieces of the edges, then inside one piece."""
    wide = math.isqrt(len(edges)) or 1
    pieces = [edges[i : i + wide] for i in range(0, len(edges), wide)]
    numbers = lambda found: F.array(*map(F.lit, found)).cast("array<double>")
    below = lambda found: F.size(F.filter(found, lambda e: e < value))
    if len(pieces) < 2:
        return below(numbers(edges))
    piece = F.greatest(below(numbers([p[0] for p in pieces])) - 1, F.lit(0))
    return piece * wide + below(F.get(F.array(*map(numbers, pieces)), piece))


def round_robin(rows: DataFrame, shards: int, number: str = "row_no") -> DataFrame:
    """`rows` with shard: row i goes to shard i mod n."""
    return rows.withColumn("shard", F.pmod(F.col(number), F.lit(shards)).cast("int"))


def offsets(rows: DataFrame, shards: int = 32, number: str = "row_no") -> DataFrame:
    """`rows` with offset: the place in the concatenation of all shards, that is by (i mod n, i).

    It follows from i alone once the rows are known to be numbered 0 to n - 1: shards before hold n / shards rows each,
    the first n mod shards of them one more.
    """
    n = rows.agg(F.count(F.lit(1))).first()[0]
    whole, more = divmod(n, shards)
    s, at = F.pmod(F.col(number), F.lit(shards)), F.floor(F.col(number) / shards)
    return rows.withColumn("offset", (s * whole + F.least(s, F.lit(more)) + at).cast("long"))


def array_split(rows: DataFrame, parts: int, number: str = "row_no") -> DataFrame:
    """`rows` with block: near equal runs of rows in order, the first n mod parts a row longer."""
    n = rows.agg(F.count(F.lit(1))).first()[0]
    whole, more = divmod(n, parts)
    long = (whole + 1) * more
    i = F.col(number)
    block = F.when(i < long, F.floor(i / (whole + 1))).otherwise(more + F.floor((i - long) / max(1, whole)))
    return rows.withColumn("block", block.cast("int"))


def token_records(rows: DataFrame, length: int) -> DataFrame:
    """pid, offset, n_tokens, token_ids of fixed width from pid, offset, ids."""
    return rows.select("pid", "offset", F.least(F.size("ids"), F.lit(length)).alias("n_tokens"), pad_passage(F.col("ids"), length).alias("token_ids"))


def pid_field(pid: Column, width: int = 64) -> Column:
    """A passage id as a field of fixed width: its UTF-8 bytes, cut or filled with zeros on the right."""
    return F.rpad(F.encode(pid, "UTF-8"), width, F.lit(b"\x00"))


def pid_of_field(field: Column) -> Column:
    """The id that a field holds, without the zeros; null if a cut left no valid UTF-8."""
    return F.rtrim(F.try_validate_utf8(F.decode(field, "UTF-8")), F.lit("\x00"))


def query_records(rows: DataFrame, length: int) -> DataFrame:
    """qid, n_tokens, token_ids of fixed width from qid (a number), ids; the first tokens stay."""
    return rows.select(F.col("qid").cast("long").alias("qid"), F.least(F.size("ids"), F.lit(length)).alias("n_tokens"), pad_passage(F.col("ids"), length).alias("token_ids"))


def flat_map(rows: DataFrame, records: Callable[[dict, int], Iterator[dict]], schema: str, number: str = "row_no") -> DataFrame:
    """What `records` yields for each row (as a dict) and its number; rows are worked on where they are."""

    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([r for row in batch.to_pylist() for r in records(row, row[number])], shape)

    return rows.mapInArrow(run, schema)


def token_ids(text: Column, tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Column:
    """Ids of whole texts (null: empty) by a tokenizer that is made once a worker."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer()
        for batch in batches:
            yield pd.Series(encode(batch.fillna("").tolist()))

    return run(text)


def file_tokenizer(path: str, most: int, special: bool = True) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """A tokenizer file for `token_ids`: `most` ids a text at most, those of special tokens included."""

    def make() -> Callable[[list[str]], list[list[int]]]:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        found = Tokenizer.from_file(path)
        found.enable_truncation(most)
        return lambda texts: [e.ids for e in found.encode_batch(texts, add_special_tokens=special)]

    return make


def largest_block(names: DataFrame, name: str = "value", pattern: str = r"(\d+)") -> DataFrame:
    """block: the largest number that the pattern finds in a file name, null if there is none."""
    number = F.regexp_extract(name, pattern, 1)
    return names.agg(F.max(F.when(number != "", number.cast("long"))).alias("block"))


def lookup_records(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records at the wanted offsets."""
    return wanted.select("offset").join(records, "offset")


def shuffled_order(records: DataFrame, seed: int) -> DataFrame:
    """Records in a repeatable permutation: a distributed sort by a hash of the offset."""
    return records.orderBy(F.xxhash64("offset", F.lit(seed)), "offset")


def wrong_widths(records: DataFrame, length: int, first: int | None = None) -> DataFrame:
    """Records of another width; of all, or of the `first` ones by offset."""
    some = records if first is None else records.orderBy("offset").limit(first)
    return some.filter(F.size("token_ids") != length)


def wrong_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """Vectors that are null, of another width, or hold what is no finite number."""
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.filter(F.coalesce((F.size("vector") != width) | ~finite, F.lit(True)))


def collection_faults(records: DataFrame, length: int) -> dict[str, int]:
    """What is wrong with a written collection, by kind: its columns' types, widths, counts, doubled ids and offsets, gaps."""
    wanted = {"pid": "string", "offset": "bigint", "n_tokens": "int", "token_ids": "array<int>"}
    types = dict(records.dtypes)
    faults = {f"type of {c}": 1 for c, t in wanted.items() if types.get(c) != t}
    if faults:
        return faults
    wide = F.count_if((F.size("token_ids") != length) | F.col("token_ids").isNull())
    counted = F.count_if(~F.col("n_tokens").between(0, length) | F.col("n_tokens").isNull())
    n, width, count, low, high = records.agg(F.count(F.lit(1)), wide, counted, F.min("offset"), F.max("offset")).first()
    twice = lambda key: records.groupBy(key).count().filter("count > 1").count()
    found = {"width": width, "n_tokens": count, "pid more than once": twice("pid"), "offset more than once": twice("offset"), "offsets": int(n > 0 and (low, high) != (0, n - 1))}
    return {k: v for k, v in found.items() if v}


def mapping_faults(pid_to_offset: DataFrame, offset_to_pid: DataFrame) -> DataFrame:
    """side, pid, offset: pairs that only one of the two mappings has."""
    a, b = (x.select("pid", "offset") for x in (pid_to_offset, offset_to_pid))
    left = a.join(b, ["pid", "offset"], "left_anti").select(F.lit("pid_to_offset").alias("side"), "pid", "offset")
    return left.unionByName(b.join(a, ["pid", "offset"], "left_anti").select(F.lit("offset_to_pid").alias("side"), "pid", "offset"))


def training_pairs(examples: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, query, pid, passage, label of examples (qid, positive, negatives: array): for every negative the positive again (1) and the negative (0)."""
    rows = examples.select("qid", "positive", F.explode("negatives").alias("negative"))
    rows = rows.select("qid", F.inline(F.array(F.struct(F.col("positive").alias("pid"), F.lit(1).alias("label")), F.struct(F.col("negative").alias("pid"), F.lit(0).alias("label")))))
    return rows.join(queries.select("qid", "query"), "qid").join(passages.select("pid", F.col("text").alias("passage")), "pid")


def training_triplets(examples: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, query, positive, negative (ids) and both texts: one row a negative."""
    rows = examples.select("qid", "positive", F.explode("negatives").alias("negative")).join(queries.select("qid", "query"), "qid")
    for side in ("positive", "negative"):
        rows = rows.join(passages.select(F.col("pid").alias(side), F.col("text").alias(f"{side}_text")), side)
    return rows
