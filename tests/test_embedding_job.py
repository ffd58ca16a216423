"""An embedding job that is stopped and goes on."""

import os

import numpy as np
import pytest

from larkspur.operators import embedding_job


def counting(folder, fail_at=None):
    """Encodes lengths; notes every text it gets, and fails at one of them while the flag is there."""

    def make():
        def run(texts):
            for text in texts:
                if text == fail_at and os.path.exists(f"{folder}/flag"):
                    raise RuntimeError("stopped")
            with open(f"{folder}/log", "a") as log:
                log.write("".join(f"{t}\n" for t in texts))
            return np.array([[len(t), t.count("e")] for t in texts], np.float32)

        return run

    return make


def test_goes_on_where_it_stopped(spark, tmp_path):
    folder, path = str(tmp_path), f"file://{tmp_path}/job"
    rows = [(str(i), f"text number {i}") for i in range(300)]
    passages = spark.createDataFrame(rows, "pid string, text string").repartition(7)
    open(f"{folder}/flag", "w").close()
    encoder = counting(folder, "text number 123")
    with pytest.raises(Exception, match="stopped"):
        embedding_job.embed(passages, path, encoder, "lengths", blocks=20, batch=8)
    half = embedding_job.finished(spark, path)
    assert 0 < len(half) < 20
    os.remove(f"{folder}/flag")
    os.rename(f"{folder}/log", f"{folder}/first")
    report = embedding_job.embed(passages.repartition(3), path, encoder, "lengths", blocks=20, batch=8)
    again = open(f"{folder}/log").read().split("\n")[:-1]
    assert report == {"blocks": 20, "before": len(half), "encoded": 300 - sum(half.values()), "rows": 300}
    assert len(again) == len(set(again)) == report["encoded"]
    got = {r["pid"]: list(r["vector"]) for r in embedding_job.vectors(spark, path).collect()}
    assert got == {p: [float(len(t)), float(t.count("e"))] for p, t in rows}
    assert embedding_job.embed(passages, path, encoder, "lengths", blocks=20)["encoded"] == 0
    with pytest.raises(ValueError, match="another job"):
        embedding_job.embed(passages, path, encoder, "other", blocks=20)


def test_null_rows_and_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/job"
    assert embedding_job.vectors(spark, path).count() == 0
    none = spark.createDataFrame([], "pid string, text string")
    assert embedding_job.embed(none, path, counting(str(tmp_path)), "lengths", blocks=3)["rows"] == 0
    odd = spark.createDataFrame([(None, "abc"), ("x", None), ("y", "")], "pid string, text string")
    report = embedding_job.embed(odd, f"{path}2", counting(str(tmp_path)), "lengths", blocks=3)
    assert report["rows"] == 3
    assert sorted((str(r["pid"]), r["vector"][0]) for r in embedding_job.vectors(spark, f"{path}2").collect()) == [("None", 3.0), ("x", 0.0), ("y", 0.0)]


def test_a_model_gets_small_batches(spark):
    """Long texts reach the model a few at a time, so that a worker's memory does not follow the table."""
    from larkspur.operators import dense

    rows = spark.range(2000, numPartitions=1).selectExpr("id", "repeat('long text ', 2000) AS text")
    sizes = dense.encode(rows, "text", lambda: lambda texts: np.full((len(texts), 1), sum(map(len, texts)), np.float32)).selectExpr("vector[0] AS n")
    assert sizes.agg({"n": "max"}).first()[0] <= 8 << 20


def test_a_model_gets_small_pieces_of_large_batches(spark):
    """What the model gets has bounds of its own, also if the Arrow batches are large after all."""
    from larkspur.operators import dense

    rows = spark.range(3000, numPartitions=1).selectExpr("id", "if(id % 10 = 0, null, repeat('x', int(id % 7) * 1000)) AS text")
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    made = dense.encode(rows, "text", lambda: lambda texts: np.array([[len(t), len(texts), sum(map(len, texts))] for t in texts], np.float32))
    was = [spark.conf.get(k) for k in keys]
    try:
        for key, most in zip(keys, (10_000, 256 << 20)):
            spark.conf.set(key, most)
        got = [(r["id"], *r["vector"]) for r in made.collect()]
    finally:
        for key, value in zip(keys, was):
            spark.conf.set(key, value)
    assert [(i, n) for i, n, _, _ in got] == [(i, 0 if i % 10 == 0 else i % 7 * 1000) for i in range(3000)]
    assert max(g[2] for g in got) <= 512 and max(g[3] for g in got) <= 4 << 20


def test_a_job_holds_no_whole_block(spark, tmp_path):
    """Texts reach the model by bytes too, vectors are written as they come."""
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/job"
    rows = spark.range(900, numPartitions=2).selectExpr("CAST(id AS string) AS pid", "repeat('long text ', if(id < 100, 20000, 1)) AS text")
    encoder = lambda: lambda texts: np.full((len(texts), 16_384), sum(map(len, texts)), np.float32)
    assert embedding_job.embed(rows, path, encoder, "wide", blocks=1)["rows"] == 900
    assert [n for n in os.listdir(f"{tmp_path}/job/vectors") if n.endswith(".parquet")] == ["block-000000.parquet"]
    assert pq.ParquetFile(f"{tmp_path}/job/vectors/block-000000.parquet").num_row_groups > 1
    got = embedding_job.vectors(spark, path).selectExpr("pid", "size(vector) AS n", "vector[0] AS most").collect()
    assert sorted(int(r["pid"]) for r in got) == list(range(900)) and {r["n"] for r in got} == {16_384}
    assert max(r["most"] for r in got) <= 4 << 20


def test_pieces_and_their_vectors():
    import pyarrow as pa

    from larkspur.operators.encoder import encoded, pieces

    texts = ["aa", None, "", "\u00e9" * 6, "b", "c" * 5, "d"]
    for array in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["zz", *texts, "z"]).slice(1, 7)):
        assert list(pieces(array, 3, 6)) == [["aa", "", ""], ["\u00e9" * 6], ["b", "c" * 5], ["d"]]
        x = list(encoded(lambda some: np.array([[len(t), 1] for t in some]), array, 3))
        assert [v for a in x for v in a.to_pylist()] == [[float(len(t or "")), 1.0] for t in texts]
    assert list(pieces(pa.array([], pa.string()))) == []
    for wrong in ((3, 2), (7,), (7, 2, 2)):
        with pytest.raises(ValueError, match="one vector a text"):
            list(encoded(lambda some, shape=wrong: np.zeros(shape), pa.array(texts)))
