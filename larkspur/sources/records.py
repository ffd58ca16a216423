"""Records of fixed width in binary files, as a data source: written in parts, read by byte ranges, sought by offset."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FORMAT = "fixed_records"
SCHEMA = "offset long, pid string, n_tokens int, token_ids array<int>"
#: Bytes of the field that holds a passage's id; longer ids are an error here, not cut.
ID_BYTES = 64
#: Bytes that one task reads, and records that one batch holds.
SPLIT, BATCH = 64 << 20, 4096


def layout(length: int, id_bytes: int = ID_BYTES) -> np.dtype:
    """A record: the id in UTF-8, filled with zeros, the number of tokens, the tokens; all integers are little-endian."""
    return np.dtype([("pid", f"S{id_bytes}"), ("n", "<i4"), ("ids", "<i4", (length,))])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifest(path: str) -> dict:
    """length, id_bytes and the parts (file, start, records) of a folder; no parts if nothing was written."""
    store, at = _store(path)
    if store.get_file_info(f"{at}/manifest.json").type == fs.FileType.NotFound:
        return {"length": None, "id_bytes": ID_BYTES, "parts": []}
    with store.open_input_stream(f"{at}/manifest.json") as file:
        return json.loads(file.read())


@dataclass
class Range(InputPartition):
    """Records of one file: `count` from `first` on, or, if given, those at `places`."""

    file: str
    start: int  # the offset of the file's first record
    first: int
    count: int
    places: tuple[int, ...] | None = None


@dataclass
class Part(WriterCommitMessage):
    file: str
    partition: int
    records: int
    length: int | None


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.low, self.high, self.only = path, split, 0, None, None
        self.found = manifest(path)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what bounds the offset; all other conditions are left to Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("offset",):
                yield f
            elif isinstance(f, EqualTo) and isinstance(value, int):
                self._among({value})
            elif isinstance(f, In):
                self._among({v for v in value if v is not None})
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and isinstance(value, int):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and isinstance(value, int):
                end = value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            else:
                yield f

    def _among(self, offsets: set[int]) -> None:
        self.only = offsets if self.only is None else self.only & offsets

    def partitions(self) -> list[InputPartition]:
        """Ranges of at most `split` bytes, and only of files that hold wanted offsets."""
        out: list[InputPartition] = []
        if not self.found["parts"]:
            return out
        many = max(1, self.split // layout(self.found["length"], self.found["id_bytes"]).itemsize)
        for part in self.found["parts"]:
            start, end = part["start"], part["start"] + part["records"]
            low, high = max(start, self.low), end if self.high is None else min(end, self.high)
            if self.only is not None:
                places = sorted(o - start for o in self.only if low <= o < high)
                out += [Range(part["file"], start, places[i], 0, tuple(places[i : i + many])) for i in range(0, len(places), many)]
            else:
                out += [Range(part["file"], start, at - start, min(many, high - at)) for at in range(low, high, many)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        kind = layout(self.found["length"], self.found["id_bytes"])
        store, at = _store(self.path)
        with store.open_input_file(f"{at}/{partition.file}") as file:
            if partition.places is None:
                runs = [(a, min(BATCH, partition.first + partition.count - a)) for a in range(partition.first, partition.first + partition.count, BATCH)]
            else:  # neighbours are read together
                spots = np.array(partition.places)
                cuts = np.flatnonzero(np.diff(spots) != 1) + 1
                runs = [(int(g[0]), len(g)) for g in np.split(spots, cuts)]
            for first, count in runs:
                file.seek(first * kind.itemsize)
                rows = np.frombuffer(file.read(count * kind.itemsize), kind)
                if len(rows) != count:
                    raise OSError(f"{partition.file} is shorter than the manifest says")
                ids = pa.ListArray.from_arrays(pa.array(np.arange(0, count * self.found["length"] + 1, self.found["length"], dtype=np.int32) if self.found["length"] else np.zeros(count + 1, np.int32)), pa.array(rows["ids"].ravel()))
                pids = pa.array([p.decode() for p in rows["pid"].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + count) + partition.start), pids, pa.array(rows["n"]), ids], names=["offset", "pid", "n_tokens", "token_ids"])


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, names: list[str]):
        self.path, self.overwrite, self.names = path, overwrite, names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One file a task, under a name of its own: what a failed attempt leaves is in no manifest."""
        partition, records, length = TaskContext.get().partitionId(), 0, None
        name = f"part-{partition:05d}-{uuid.uuid4().hex}.bin"
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/{name}") as file:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                pids, counts, ids = (batch.column(self.names.index(c)) for c in ("pid", "n_tokens", "token_ids"))
                widths = set(ids.value_lengths().to_pylist())
                if pids.null_count or counts.null_count or ids.null_count or ids.flatten().null_count or len(widths) > 1 or length not in (None, *widths):
                    raise ValueError("records need an id, a count and equally many tokens, none of them null")
                length = widths.pop()
                coded = [p.encode() for p in pids.to_pylist()]
                if any(len(p) > ID_BYTES or p.endswith(b"\x00") for p in coded):
                    raise ValueError(f"an id has more than {ID_BYTES} bytes or ends with a zero")
                rows = np.zeros(batch.num_rows, layout(length))
                rows["pid"], rows["n"] = coded, counts.to_numpy()
                rows["ids"] = ids.flatten().to_numpy().reshape(batch.num_rows, length)
                file.write(rows.tobytes())
                records += batch.num_rows
        return Part(name, partition, records, length)

    def commit(self, messages: list[Part | None]) -> None:
        """Puts the parts behind each other in the order of their partitions: one new manifest, moved into place."""
        store, at = _store(self.path)
        before = manifest(self.path)
        kept = [] if self.overwrite else before["parts"]
        parts = sorted((m for m in messages if m and m.records), key=lambda m: m.partition)
        lengths = {m.length for m in parts} | ({before["length"]} if kept else set())
        if len(lengths) > 1:
            self.abort(messages)
            raise ValueError(f"records of different widths: {sorted(lengths)}")
        start = sum(p["records"] for p in kept)
        for m in parts:
            kept = [*kept, {"file": m.file, "start": start, "records": m.records}]
            start += m.records
        state = {"length": lengths.pop() if lengths else before["length"], "id_bytes": ID_BYTES, "parts": kept}
        store.create_dir(at, recursive=True)
        temporary = f"{at}/manifest-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as file:
            file.write(json.dumps(state, indent=1).encode())
        store.move(temporary, f"{at}/manifest.json")
        for m in messages:
            if m and not m.records:
                store.delete_file(f"{at}/{m.file}")
        if self.overwrite:  # only now, so that a failure leaves the old records whole
            for p in before["parts"]:
                store.delete_file(f"{at}/{p['file']}")

    def abort(self, messages: list[Part | None]) -> None:
        store, at = _store(self.path)
        for m in messages:
            if m and store.get_file_info(f"{at}/{m.file}").type != fs.FileType.NotFound:
                store.delete_file(f"{at}/{m.file}")


class FixedRecords(DataSource):
    """offset, pid, n_tokens, token_ids. Records have the offsets of their places: the first partition's come first.

    Options: path; split, the bytes that one task reads. Written rows need pid, n_tokens and token_ids, of one width;
    append goes on behind what is there.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, [f.name for f in schema.fields])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand conditions on the offset down to it."""
    spark.dataSource.register(FixedRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("split", split).load(path)


def write(records: DataFrame, path: str, mode: str = "overwrite", order: str | None = None) -> None:
    """Writes records (pid, n_tokens, token_ids), with `order` sorted by that column over all partitions."""
    register(records.sparkSession)
    dealt = records.repartitionByRange(order).sortWithinPartitions(order) if order else records
    dealt.select("pid", "n_tokens", "token_ids").write.format(FORMAT).mode(mode).save(path)
