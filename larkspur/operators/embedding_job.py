"""Embedding a collection block by block, so that a run that ended early goes on where it stopped."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import storage
from larkspur.operators.encoder import encoded

#: Bytes of vectors, and pieces of them, that are held before they are written.
GROUP, PIECES = 16 << 20, 1024
FORM = pa.schema([("pid", pa.string()), ("vector", pa.list_(pa.float32()))])
Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def finished(spark, path: str) -> dict[int, int]:
    """Rows of each block that is there whole."""
    out = {}
    for name in storage.names(spark, f"{path}/done"):
        block, _, rows = name.removesuffix(".json").partition("-")
        if name.endswith(".json") and block.isdigit() and rows.isdigit():
            out[int(block)] = int(rows)
    return out


def embed(passages: DataFrame, path: str, encoder: Encoder, name: str, blocks: int = 256, batch: int = 64, profile=None) -> dict:
    """Writes pid, vector of `passages` (pid, text) below `path` in `blocks` blocks by a hash of pid; returns what was done.

    A block's vectors are one Parquet file, put in place as soon as the block is through and then noted by a file of its
    own; a later run of the same job reads the notes and encodes the other blocks only, whichever tasks or runs have
    failed. A task that is repeated writes the same file again. Another `name` (of the model) or number of blocks is
    another job: an error in the same folder. Null texts are empty; rows without pid are in one block with pid null.
    A worker holds some texts and about GROUP bytes of vectors, never a whole block; what a killed task leaves has a name
    with a dot in front and is not read.
    `profile` is a resource profile for the stage that encodes (on clusters that have them), such as one with a GPU.
    """
    spark, path = passages.sparkSession, path.rstrip("/")
    job = {"model": name, "blocks": blocks}
    if not storage.create(spark, f"{path}/job.json", json.dumps(job).encode()) and (was := json.loads(storage.read_text(spark, f"{path}/job.json"))) != job:
        raise ValueError(f"{path} holds another job: {was}")
    done = finished(spark, path)
    missing = sorted(set(range(blocks)) - set(done))
    if missing:
        numbered = passages.select(F.col("pid").cast("string").alias("pid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("block", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int"))
        left = spark.createDataFrame([(b,) for b in missing], "block int")
        dealt = numbered.join(F.broadcast(left), "block").repartition(len(missing), "block").sortWithinPartitions("block", "pid")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, now = None, None
            try:
                for piece in batches:
                    numbers = piece.column(0).to_numpy()
                    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), piece.num_rows]
                    for a, b in zip(cuts, cuts[1:]):
                        if a == b:
                            continue
                        if now and numbers[a] != now.block:
                            yield now.finish()
                            now = None
                        model, now = model or encoder(), now or _Block(path, int(numbers[a]))
                        for x in encoded(model, piece.column(2).slice(a, b - a), batch):
                            now.add(piece.column(1).slice(a, len(x)), x)
                            a += len(x)
                if now:
                    yield now.finish()
                    now = None
            finally:
                if now:
                    now.drop()

        storage.small_batches(spark)
        wrote = dealt.select("block", "pid", "text").mapInArrow(run, "block int, rows long", profile=profile) if profile else dealt.select("block", "pid", "text").mapInArrow(run, "block int, rows long")
        new = {r["block"]: r["rows"] for r in wrote.collect()}  # a row a block
        for block in set(missing) - set(new):  # nothing to encode in them
            storage.create(spark, f"{path}/done/{block}-0.json")
        return {"blocks": blocks, "before": len(done), "encoded": sum(new.values()), "rows": sum(finished(spark, path).values())}
    return {"blocks": blocks, "before": len(done), "encoded": 0, "rows": sum(done.values())}


class _Block:
    """A block's file: under another name while vectors come, then in place, then its note."""

    def __init__(self, path: str, block: int):
        self.store, self.at = _store(path)
        self.block, self.rows, self.held, self.size = block, 0, [], 0
        self.store.create_dir(f"{self.at}/vectors", recursive=True)
        self.store.create_dir(f"{self.at}/done", recursive=True)
        self.temporary = f"{self.at}/vectors/.{uuid.uuid4().hex}"
        self.file = self.store.open_output_stream(self.temporary)
        self.writer = pq.ParquetWriter(self.file, FORM)

    def add(self, pids: pa.Array, x: pa.Array) -> None:
        """Ids are copied: a slice would keep the texts that came with it."""
        self.held.append(pa.table([pa.array(pids.to_pylist(), pa.string()), x], schema=FORM))
        self.rows, self.size = self.rows + len(x), self.size + self.held[-1].nbytes
        if self.size >= GROUP or len(self.held) >= PIECES:
            self.write()

    def write(self) -> None:
        if self.held:
            self.writer.write_table(pa.concat_tables(self.held).combine_chunks())
        self.held, self.size = [], 0

    def finish(self) -> pa.RecordBatch:
        self.write()
        self.writer.close()
        self.file.close()
        self.store.move(self.temporary, f"{self.at}/vectors/block-{self.block:06d}.parquet")
        with self.store.open_output_stream(f"{self.at}/done/{self.block}-{self.rows}.json") as file:
            file.write(b"{}")
        return pa.RecordBatch.from_pydict({"block": pa.array([self.block], pa.int32()), "rows": pa.array([self.rows], pa.int64())})

    def drop(self) -> None:
        """Takes away what is not whole."""
        with contextlib.suppress(OSError):
            self.file.close()
        with contextlib.suppress(OSError):
            self.store.delete_file(self.temporary)


def vectors(spark, path: str) -> DataFrame:
    """pid, vector of all blocks that are through."""
    there = any(n.endswith(".parquet") for n in storage.names(spark, f"{path.rstrip('/')}/vectors"))
    schema = "pid string, vector array<float>"
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/vectors") if there else spark.createDataFrame([], schema)
