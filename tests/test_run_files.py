"""Runs as single files."""

import os
import threading

import pytest

from larkspur.sources import run_files


def run(spark, n=500):
    rows = [(f"q{i % 7}", f"p{i}", i // 7 + 1, 100.0 - i) for i in range(n)]
    return spark.createDataFrame(rows, "qid string, pid string, rank int, score double"), rows


def test_same_bytes_for_any_partitions(spark, tmp_path):
    frame, rows = run(spark)
    seen = set()
    for parts in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        path = run_files.write_run_file(frame.repartition(parts), f"file://{tmp_path}/{parts}.trec", "tag")
        seen.add(open(path[7:], "rb").read())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    expected = "".join(f"{q} Q0 {p} {r} {s} tag\n" for q, p, r, s in sorted(rows, key=lambda x: (x[0], x[2])))
    assert seen == {expected.encode()}
    assert sorted(os.listdir(tmp_path)) == ["1.trec", "16.trec", "4.trec"]


def test_a_taken_name_is_an_error_and_stays(spark, tmp_path):
    frame, _ = run(spark, 20)
    (tmp_path / "a.trec").write_text("old")
    with pytest.raises(FileExistsError):
        run_files.write_run_file(frame, f"file://{tmp_path}/a.trec", "tag")
    assert (tmp_path / "a.trec").read_text() == "old" and os.listdir(tmp_path) == ["a.trec"]


def test_two_writers_get_two_names(spark, tmp_path):
    frame, _ = run(spark, 50)
    got = []
    threads = [threading.Thread(target=lambda: got.append(run_files.write_run_file(frame, f"{tmp_path}/a.trec", "tag", numbered=True))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [f"{tmp_path}/a_run{i}.trec" for i in (1, 2, 3, 4)]
    assert len({open(p).read() for p in got}) == 1 and sorted(os.listdir(tmp_path)) == [f"a_run{i}.trec" for i in (1, 2, 3, 4)]


def test_empty_run(spark, tmp_path):
    frame, _ = run(spark, 5)
    path = run_files.write_run_file(frame.limit(0), f"{tmp_path}/none.trec", "tag")
    assert open(path).read() == ""
