"""A run as one ordered file: parts of known lengths, written at their places in parallel, under a name nobody else has."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import storage
from larkspur.sources.writers import run_lines

COPY = 4 << 20


def _local(path: str) -> str | None:
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _parts(lines: DataFrame, folder: str) -> list[tuple[int, str, int]]:
    """Writes each partition's lines to a file of its own; (partition, file, bytes), in order: a row a task."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId(), 0
        name = f"{folder}/{number:06d}-{uuid.uuid4().hex}"  # a failed attempt's file is in no list
        store, at = (fs.LocalFileSystem(), _local(name)) if _local(name) else fs.FileSystem.from_uri(name)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(at) as file:
            for batch in batches:
                data = "".join(f"{v}\n" for v in batch.column(0).to_pylist()).encode()
                file.write(data)
                size += len(data)
        yield pa.RecordBatch.from_pydict({"part": [number], "file": [name], "size": pa.array([size], pa.int64())})

    found = lines.select("value").mapInArrow(run, "part long, file string, size long").collect()
    return sorted((r["part"], r["file"], r["size"]) for r in found)


def _compose(lines: DataFrame, parts: list[tuple[int, str, int]], whole: str) -> None:
    """Puts the parts behind each other into `whole`, whose name is nobody's yet.

    In a folder that all machines mount, every task writes its parts at the sum of the lengths before; in other stores
    the store joins the files, if it can (as HDFS does). No part passes through the driver.
    """
    spark, starts, at = lines.sparkSession, [], 0
    for _, file, size in parts:
        starts.append((file, at, size))
        at += size
    if path := _local(whole):
        with open(path, "wb") as file:
            file.truncate(at)

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                    with open(_local(part), "rb") as source, open(path, "r+b") as target:
                        target.seek(start)
                        while data := source.read(COPY):
                            target.write(data)
                            size -= len(data)
                    if size:
                        raise OSError(f"{part} has not the length that it had")
                yield batch.select([])  # nothing comes back

        rows = [s for s in starts if s[2]]
        if rows:
            spark.createDataFrame(rows, "file string, start long, size long").repartition(len(rows), "start").mapInArrow(lambda b: (pa.RecordBatch.from_pydict({"n": [x.num_rows]}) for x in copy(b)), "n long").collect()
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(whole).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    storage.create(spark, whole)
    sources = spark.sparkContext._gateway.new_array(hadoop.Path, sum(1 for s in starts if s[2]))
    for i, (file, _, _) in enumerate(s for s in starts if s[2]):
        sources[i] = hadoop.Path(file)
    store.concat(hadoop.Path(whole), sources)


def _claim(spark, whole: str, path: str) -> bool:
    """Gives the file its name, unless that is taken."""
    if target := _local(path):
        try:
            os.link(_local(whole), target)
        except FileExistsError:
            return False
        os.unlink(_local(whole))
        return True
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not store.exists(hadoop.Path(path)) and store.rename(hadoop.Path(whole), hadoop.Path(path))


def write_run_file(run: DataFrame, path: str, tag: str, numbered: bool = False, **form) -> str:
    """Writes a run (qid, pid, rank, score) as one file, by qid, then rank; returns its path.

    The bytes are the same for any number of partitions. The file has its name only when it is whole. If the name is
    taken that is an error; `numbered` takes the first free of name_run1, name_run2, ... instead, and two writers never
    get one name.
    """
    spark, folder = run.sparkSession, path.rsplit("/", 1)[0]
    if local := _local(folder):
        os.makedirs(local, exist_ok=True)
    work = f"{folder}/.{uuid.uuid4().hex}"
    lines = run_lines(run.orderBy("qid", "rank", F.col("pid").cast("string")), tag, **form)
    try:
        parts = _parts(lines, f"{work}-parts")
        _compose(lines, parts, f"{work}-whole")
        stem, dot, end = path.rpartition(".") if "." in path.rsplit("/", 1)[-1] else (path, "", "")
        names = (f"{stem}_run{i}{dot}{end}" for i in range(1, 1 << 30)) if numbered else iter([path])
        for name in names:
            if _claim(spark, f"{work}-whole", name):
                return name
        raise FileExistsError(path)
    finally:
        for left in (f"{work}-parts", f"{work}-whole"):
            storage.delete(spark, left)
