"""Files to DataFrames. Lines keep their place where their order means something."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur import schemas
from larkspur.functions.text import normalise_qid
from larkspur.operators.indexing import row_index


def topics(spark: SparkSession, path: str) -> DataFrame:
    """Nested conversations from one JSON array."""
    return spark.read.schema(schemas.TOPIC).json(path, multiLine=True)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of text files (gzip too); numbers rise through each file in turn, without gaps only inside a split."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def split_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """split (from 0), line_no, value of several files as one stream: by split, then by line_no."""
    parts = [numbered_lines(spark, p).select(F.lit(i).alias("split"), "line_no", "value") for i, p in enumerate(paths)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def offset_map(spark: SparkSession, path: str) -> DataFrame:
    """offset, pid of a collection written as Parquet: only these two columns are read."""
    return spark.read.parquet(path).select("offset", "pid")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of whole files (each is read into one task's memory; files of more than 2 GB are an error)."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def wrong_digests(found: DataFrame, expected: DataFrame) -> DataFrame:
    """name, fault of expected (name, sha256) files that are missing or differ, by the last part of found paths."""
    named = found.select(F.substring_index("path", "/", -1).alias("name"), F.col("sha256").alias("_found"))
    fault = F.when(F.col("_found").isNull(), F.lit("missing")).when(F.col("_found") != F.lower("sha256"), F.lit("differs"))
    return expected.join(named, "name", "left").select("name", fault.alias("fault")).filter("fault is not null")


def json_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON lines (column value, maybe line_no); lines that are not JSON objects, and blank ones, are skipped."""
    rows = lines.withColumn("_row", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    rows = rows.filter(F.col("_row").isNotNull() & F.col("_row._bad").isNull() & (F.trim("value") != ""))
    return rows.select(*[c for c in lines.columns if c != "value"], "_row.*").drop("_bad")


def turns(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(numbered_lines(spark, path), schemas.FLAT_TURN)


def _fields(lines: DataFrame) -> DataFrame:
    # from a generator: filters on fields stay above it, and a line is cut once and not again for each of them
    return lines.select("*", F.explode_outer(F.array(F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0)))).alias("_f"))


def assessed_ids(lines: DataFrame) -> DataFrame:
    """qid: distinct ids of judgement lines with at least four fields."""
    return _fields(lines).filter(F.size("_f") >= 4).select(normalise_qid(F.get("_f", F.lit(0))).alias("qid")).distinct()


def qrels(lines: DataFrame, threshold: int = 1) -> DataFrame:
    """qid, pid, rel, hit (0/1 by threshold) of judgement lines; of equal (qid, pid) the last line counts."""
    rows = _fields(lines).filter(F.size("_f") >= 4).select("line_no", normalise_qid(F.get("_f", F.lit(0))).alias("qid"), F.get("_f", F.lit(2)).alias("pid"), F.get("_f", F.lit(3)).cast("int").alias("rel"))
    # always so; said here, all who join them read one exchange
    rows = rows.filter("qid is not null and pid is not null")
    last = rows.groupBy("qid", "pid").agg(F.max_by("rel", "line_no").alias("rel"))
    return last.withColumn("hit", (F.col("rel") >= threshold).cast("int"))


def run(lines: DataFrame) -> DataFrame:
    """qid, pid, score, line_no of run lines with six or seven columns; of equal (qid, pid) the last line counts."""
    rows = _fields(lines).filter(F.size("_f") >= 5).select("line_no", F.get("_f", F.lit(0)).alias("qid"), F.get("_f", F.lit(2)).alias("pid"), F.get("_f", F.lit(4)).cast("double").alias("score"))
    return rows.groupBy("qid", "pid").agg(F.max_by("score", "line_no").alias("score"), F.min("line_no").alias("line_no"))


def passages_json(lines: DataFrame, most_characters: int = 10_000) -> DataFrame:
    """id, contents without white space at the end, cut; bad lines are skipped."""
    rows = json_rows(lines, schemas.PASSAGE)
    return rows.select("id", F.substring(F.regexp_replace("contents", r"(?U)\s+$", ""), 1, most_characters).alias("contents"))


def passages_tsv(lines: DataFrame, title: bool = False, most_characters: int = 10_000) -> DataFrame:
    """id, contents of tab-separated lines; in title form column 2 (' [SEP] ' as space), a space, column 1. Short lines are skipped."""
    rows = lines.select(F.split("value", "\t").alias("_f")).filter(F.size("_f") >= (3 if title else 2))
    get = lambda i: F.get("_f", F.lit(i))
    text = F.concat(F.replace(get(2), F.lit(" [SEP] "), F.lit(" ")), F.lit(" "), get(1)) if title else get(1)
    return rows.select(get(0).alias("id"), F.substring(F.regexp_replace(text, r"(?U)\s+$", ""), 1, most_characters).alias("contents"))


def first_fraction(rows: DataFrame, fraction: float, order: str = "line_no") -> DataFrame:
    """The first int(fraction n) rows in file order, each told by its place, which comes from ranges of the order column."""
    n = int(rows.count() * fraction)
    return row_index(rows, order, name="_place").filter(F.col("_place") < n).drop("_place")


def with_fallbacks(rows: DataFrame) -> DataFrame:
    """qid and query of a row in any of the record forms: id or sample_id; output, rewrite or resolved utterance."""
    return rows.select(F.coalesce("id", "sample_id").alias("qid"), F.coalesce("output", "rewrite_utt_text", "oracle_utt_text").alias("query"))


def batch_responses(lines: DataFrame) -> DataFrame:
    """custom_id, content of answered requests; rows without choices or content are dropped, repeated ids count once (last)."""
    rows = json_rows(lines, schemas.BATCH_RESPONSE)
    content = F.get(F.col("response.body.choices"), F.lit(0))["message"]["content"]
    rows = rows.select("line_no", "custom_id", content.alias("content")).filter(F.coalesce("content", F.lit("")) != "")
    last = Window.partitionBy("custom_id").orderBy(F.desc("line_no"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("custom_id", "content")
