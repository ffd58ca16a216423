"""Answers of a remote model, each request's once, under one budget of calls for all tasks together."""

from __future__ import annotations

import socket
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import storage
from larkspur.operators.embedding_job import _store

ANSWERS = "id string, answer string"
Provider = Callable[[], Callable[[str, str], str]]


class RateBudget:
    """Permits for calls, given out by the driver at a steady rate to whoever asks, over a socket.

    Permits that nobody used do not add up, so any second sees at most the rate (and one call more, at its edge).
    """

    def __init__(self, per_second: float, host: str | None = None):
        self.gap, self.next, self.lock = 1.0 / per_second, 0.0, threading.Lock()
        self.server = socket.create_server((host or "", 0))
        self.address = (host or socket.gethostbyname(socket.gethostname()), self.server.getsockname()[1])
        threading.Thread(target=self._serve, daemon=True).start()

    def _serve(self) -> None:
        while True:
            try:
                client, _ = self.server.accept()
            except OSError:  # closed
                return
            threading.Thread(target=self._permits, args=(client,), daemon=True).start()

    def _permits(self, client: socket.socket) -> None:
        with client:
            while client.recv(1):
                with self.lock:
                    at = max(time.monotonic(), self.next)
                    self.next = at + self.gap
                time.sleep(max(0.0, at - time.monotonic()))
                client.sendall(b"1")

    def close(self) -> None:
        self.server.close()


class _Asker:
    """A task's line to the budget."""

    def __init__(self, address: tuple[str, int] | None):
        self.line = socket.create_connection(address) if address else None

    def wait(self) -> None:
        if self.line:
            self.line.sendall(b"?")
            if not self.line.recv(1):
                raise ConnectionError("the budget is gone")

    def close(self) -> None:
        if self.line:
            self.line.close()


def answer_all(prompts: DataFrame, path: str, provider: Provider, system: str, batches: int = 64, tries: int = 3, budget: RateBudget | None = None) -> dict:
    """Asks for every id of `prompts` (id, prompt) that has no answer below `path` yet; returns how many have one.

    Requests go in micro-batches by a hash of the id, each with one file that its number names: what is in it is read
    first, only the rest is asked, and the file is replaced whole. So each id has one answer however often tasks, runs
    or the provider are repeated; of ids that come more than once the first prompt (by text) counts. A call that fails is
    made again, `tries` times in all, then left for a later run. Null ids and prompts are not asked. Every call, repeated
    ones too, takes a permit of `budget`.
    """
    spark, path, address = prompts.sparkSession, path.rstrip("/"), budget.address if budget else None
    rows = prompts.select(F.col("id").cast("string").alias("id"), F.col("prompt").cast("string").alias("prompt")).filter("id is not null and prompt is not null")
    rows = rows.groupBy("id").agg(F.min("prompt").alias("prompt")).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker, chat, batch, todo = _Asker(address), provider(), None, []
        try:
            for piece in pieces:
                for number, key, prompt in zip(*(c.to_pylist() for c in piece.columns)):
                    if batch is not None and number != batch:
                        yield _batch(path, batch, todo, chat, system, tries, asker)
                        todo = []
                    batch = number
                    todo.append((key, prompt))
            if batch is not None:
                yield _batch(path, batch, todo, chat, system, tries, asker)
        finally:
            asker.close()

    dealt = rows.repartition(batches, "batch").sortWithinPartitions("batch", "id").select("batch", "id", "prompt")
    found = dealt.mapInArrow(run, "answered long, asked long, failed long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("answered", "asked", "failed")])
    return found.first().asDict()


def _batch(path: str, number: int, todo: list[tuple[str, str]], chat, system: str, tries: int, asker: _Asker) -> pa.RecordBatch:
    store, at = _store(path)
    name = f"{at}/answers/batch-{number:06d}.parquet"
    known: dict[str, str] = {}
    if store.get_file_info(name).type != fs.FileType.NotFound:
        with store.open_input_file(name) as file:
            table = pq.read_table(file)
        known = dict(zip(table.column("id").to_pylist(), table.column("answer").to_pylist()))
    asked = failed = 0
    for key, prompt in todo:
        if key in known:
            continue
        for left in range(tries - 1, -1, -1):
            asker.wait()
            asked += 1
            try:
                known[key] = chat(system, prompt)
                break
            except Exception:  # noqa: BLE001  whatever a provider throws: the id is left for a later run
                failed += not left
    if asked:
        store.create_dir(f"{at}/answers", recursive=True)
        temporary = f"{at}/answers/.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as file:
            pq.write_table(pa.table({"id": list(known), "answer": list(known.values())}, schema=pa.schema([("id", pa.string()), ("answer", pa.string())])), file)
        store.move(temporary, name)
    return pa.RecordBatch.from_pydict({"answered": pa.array([sum(k in known for k, _ in todo)], pa.int64()), "asked": pa.array([asked], pa.int64()), "failed": pa.array([failed], pa.int64())})


def answers(spark, path: str) -> DataFrame:
    """id, answer of all that is answered, each id once."""
    folder = f"{path.rstrip('/')}/answers"
    there = any(n.endswith(".parquet") for n in storage.names(spark, folder))
    return spark.read.schema(ANSWERS).parquet(folder) if there else spark.createDataFrame([], ANSWERS)
