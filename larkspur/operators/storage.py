"""Folders that the driver and all tasks share, through Hadoop's file systems: manifests, scratch tables."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, path)
    return store.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    store, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    store, at = _at(spark, path)
    store.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    store, at = _at(spark, path)
    stream = store.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, data: bytes = b"") -> bool:
    """Makes a new file with this content; False, and nothing changed, if there is one of that name already."""
    store, at = _at(spark, path)
    try:
        stream = store.create(at, False)
    except Exception as error:
        if store.exists(at):
            return False
        raise error
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    return True


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; with a local master and no such setting, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/larkspur-{uuid.uuid4().hex}/{label}"


def kept(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back, so that it is made once and lost executors cost nothing."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> None:
    """Bounds what one Arrow batch hands to a Python worker, in rows and bytes. Lower settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        value = int(now) if now and str(now).isdigit() else 0
        if not 0 < value <= most:
            spark.conf.set(key, str(most))


class Manifest:
    """Numbered states of a folder, each one small JSON file that is never changed; the last one counts.

    A writer that comes second for a number gets an error and leaves the other's state in place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def last(self) -> tuple[int, dict | None]:
        """The state's number and content; 0 and None if there is none. One that is still being written does not count."""
        for name in reversed(names(self.spark, self.path)):
            if name.endswith(".json") and name[:-5].isdigit():
                try:
                    return int(name[:-5]), json.loads(read_text(self.spark, f"{self.path}/{name}"))
                except ValueError:
                    continue
        return 0, None

    def put(self, after: int, state: dict) -> None:
        if not create(self.spark, f"{self.path}/{after + 1:08d}.json", json.dumps(state, indent=1).encode()):
            raise RuntimeError(f"{self.path}: another writer has put state {after + 1}")
