"""The record files: round trips, byte ranges, offsets, parts that fail."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringStartsWith

from larkspur.sources import records


def table(spark, n, length=5, parts=4):
    ids = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (F.col("id") * 31 + i).cast("int"))
    return spark.range(n).repartition(parts).select(F.concat(F.lit("p-é-"), F.col("id")).alias("pid"), "id", (F.col("id") % 6).cast("int").alias("n_tokens"), ids.alias("token_ids"))


def rows(df):
    return sorted((r["offset"], r["pid"], r["n_tokens"], tuple(r["token_ids"])) for r in df.collect())


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('records')}"
    records.write(table(spark, 1000), path, order="id")
    return path


def expected(i, length=5):
    return (i, f"p-é-{i}", i % 6, tuple(i * 31 + k for k in range(1, length + 1)))


def test_round_trip_in_order(spark, written):
    assert rows(records.read(spark, written)) == [expected(i) for i in range(1000)]
    small = records.read(spark, written, split=2000)
    assert small.rdd.getNumPartitions() > 30 and rows(small) == [expected(i) for i in range(1000)]
    size = sum(os.path.getsize(os.path.join(written[7:], f)) for f in os.listdir(written[7:]) if f.endswith(".bin"))
    assert size == 1000 * records.layout(5).itemsize == 1000 * (64 + 4 + 20)


def test_offsets_open_their_ranges_only(spark, written):
    wanted = [3, 4, 5, 777, 5000, -1]
    assert rows(records.read(spark, written).filter(F.col("offset").isin(wanted))) == [expected(i) for i in (3, 4, 5, 777)]
    assert rows(records.read(spark, written).filter("offset = 998 and pid = 'p-é-998'")) == [expected(998)]
    assert rows(records.read(spark, written).filter("offset >= 10 and offset < 13 and n_tokens > 4")) == [expected(11)]
    reader = records.Reader(written, records.SPLIT)
    left = list(reader.pushFilters([In(("offset",), (3, 4, 777)), StringStartsWith(("pid",), "p")]))
    assert len(left) == 1 and sorted(len(p.places) for p in reader.partitions()) in ([1, 2], [3])
    reader = records.Reader(written, records.SPLIT)
    assert not list(reader.pushFilters([GreaterThanOrEqual(("offset",), 10), LessThan(("offset",), 20)]))
    assert sum(p.count for p in reader.partitions()) == 10
    reader = records.Reader(written, records.SPLIT)
    list(reader.pushFilters([EqualTo(("offset",), 10_000)]))
    assert reader.partitions() == []


def test_append_overwrite_and_failure(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    records.write(table(spark, 10), path, order="id")
    records.write(table(spark, 5), path, mode="append", order="id")
    assert [(r[0], r[1]) for r in rows(records.read(spark, path))] == [(i, f"p-é-{i % 10}") for i in range(15)]
    before = rows(records.read(spark, path))
    broken = table(spark, 10).withColumn("n_tokens", F.when(F.col("id") == 7, F.raise_error(F.lit("no")).cast("int")).otherwise(F.col("n_tokens")))
    for bad in (broken, table(spark, 4, length=6), table(spark, 3).withColumn("pid", F.lit(None).cast("string")), table(spark, 3).withColumn("pid", F.repeat(F.lit("x"), F.lit(65)))):
        with pytest.raises(Exception):
            records.write(bad, path, mode="append")
        assert rows(records.read(spark, path)) == before
    records.write(table(spark, 3, length=2), path, order="id")
    assert rows(records.read(spark, path)) == [expected(i, 2) for i in range(3)]
    known = {p["file"] for p in records.manifest(path)["parts"]} | {"manifest.json"}
    assert {f for f in os.listdir(path[7:]) if not f.startswith(".")} >= known


def test_empty_folder_and_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert records.read(spark, path).count() == 0
    records.write(table(spark, 10).limit(0), path)
    assert records.read(spark, path).count() == 0 and records.manifest(path)["parts"] == []


def test_layout_is_plain_bytes(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    records.write(spark.createDataFrame([("ab", 2, [7, -1])], "pid string, n_tokens int, token_ids array<int>"), path)
    (name,) = (f for f in os.listdir(path[7:]) if f.endswith(".bin"))
    raw = open(os.path.join(path[7:], name), "rb").read()
    assert raw == b"ab".ljust(64, b"\x00") + np.array([2, 7, -1], "<i4").tobytes()
