"""What the training-data operators share: table reading, the shared folder, ranks without single-task windows."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    # with its scheme, which Python workers need to tell a local folder from the cluster's store
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/larkspur-{uuid.uuid4().hex}/{label}"
    _made.append((spark, path.rsplit("/", 1)[0]))
    return path


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text and `_row`, all other columns in one struct, so that no name of theirs meets one of ours."""
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("_row"))


def unboxed(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The boxed columns again, in their old order, with some of them changed."""
    return rows.select(*[(changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col(f"_row.`{c}`"))).alias(c) for c in columns])


def small_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> None:
    """Bounds what one Arrow batch hands to a Python worker, in rows and bytes: texts may be long. Lower settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        value = int(now) if now and str(now).isdigit() else 0
        if not 0 < value <= most:
            spark.conf.set(key, str(most))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def hash_bits(*cols: Column) -> Column:
    """A non-negative long."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def running(df: DataFrame, keys: list[str], order: list[str], rows: int, rank: str, weight: str | None = None, start: str | None = None, per_bucket: int = 50_000, narrow: DataFrame | None = None) -> DataFrame:
    """Adds `rank`, each row's place (from 0) in its key, and with `weight` also `start`, the weights before it.

    The order is a fixed pseudo-random one: by a hash of `order`, then `order`. Rows go by bucket, the hash's leading bits,
    so that the order is the same for any number of buckets; their number follows `rows`, so that a key with any share of
    all rows is dealt over many tasks. Bucket totals are summed up per key and joined back on (key, bucket), whose
    partitioning the last window reuses. Keys must not be null. `df` is read twice: pass a materialised table, or
    `narrow`, a cheaper table with the same keys, order and weight for the totals. Rows alike in all of `order` are
    interchangeable.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = math.ceil(math.log2(max(1, min(rows, max(tasks, math.ceil(rows / per_bucket))))))
    marked = lambda x: x.withColumn("_h", hash_bits(*[F.col(c) for c in order])).withColumn("_b", F.shiftright("_h", 63 - bits))
    dealt = marked(df)
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = (dealt if narrow is None else marked(narrow)).groupBy(*keys, "_b").agg(*sums)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *([F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0")] if weight else []))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", *order)
    out = dealt.join(offsets, [*keys, "_b"])
    out = out.withColumn(rank, F.col("_n0") + F.row_number().over(inside) - 1)
    if weight:
        out = out.withColumn(start, F.col("_w0") + F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("_h", "_b", "_n0", "_w0")
