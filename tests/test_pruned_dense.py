"""The search with bounds against the plain one."""

import numpy as np
import pytest

from larkspur.operators import dense, pruned_dense
from larkspur.plans import standins as I

SMALL = "/root/testdata/sf0.01"


def rows(df):
    return sorted((r["qid"], r["pid"], round(r["score"], 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("k", "block"), [(1, 32), (20, 64), (1000, 64), (10, 4096)])
def test_same_rows_as_the_plain_search(spark, k, block):
    passages, queries = I.vectors(spark, SMALL), I.vector_queries(spark, SMALL)
    report: dict = {}
    assert rows(pruned_dense.topk(passages, queries, k, report, block=block)) == rows(dense.topk(passages, queries, k))
    assert report["multiplied"] <= report["pairs"]


def test_blocks_that_cannot_matter_are_left_out(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 3
    vectors = [(str(i), (centres[i % 20] + rng.normal(size=16) * 0.2).tolist()) for i in range(2000)]
    vectors += [(f"t{i}", vectors[0][1]) for i in range(50)]  # ties
    passages = spark.createDataFrame(vectors, "pid string, vector array<double>")
    queries = spark.createDataFrame([(str(i), (centres[i % 20] * rng.uniform(0.5, 2)).tolist()) for i in range(40)], "qid string, vector array<double>")
    report: dict = {}
    assert rows(pruned_dense.topk(passages, queries, 10, report, block=50)) == rows(dense.topk(passages, queries, 10))
    assert report["multiplied"] < report["pairs"] / 4


def test_bounds_hold(spark):
    passages = I.vectors(spark, SMALL)
    found = pruned_dense.blocks(passages, pruned_dense.storage.scratch(spark, "b"), block=64).collect()
    assert sum(b["n"] for b in found) == passages.count() and len(found) > 4
    for b in found:
        x = np.frombuffer(b["x"]).reshape(b["n"], -1)
        assert np.linalg.norm(x - np.array(b["centre"]), axis=1).max() <= b["radius"]


def test_few_and_odd_rows(spark):
    make = lambda kind, *r: spark.createDataFrame(list(r), f"{kind} string, vector array<double>")
    passages = make("pid", ("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", None), ("d", [-1.0, 2.0]))
    queries = make("qid", ("q", [1.0, 1.0]), ("z", [0.0, 0.0]), ("n", None))
    assert rows(pruned_dense.topk(passages, queries, 2)) == [("q", "b", 1.0, 1), ("q", "d", 1.0, 2), ("z", "a", 0.0, 1), ("z", "b", 0.0, 2)]
    assert pruned_dense.topk(passages.limit(0), queries, 2).count() == 0 and pruned_dense.topk(passages, queries.limit(0), 2).count() == 0


def test_what_a_task_holds_is_bounded(spark):
    """A group keeps k hits a query between cuts; copies of one vector and many blocks change nothing."""
    rng = np.random.default_rng(4)
    x, q = rng.integers(-3, 4, (5000, 8)).astype(float), rng.normal(size=(40, 8))
    best = dense.Best([str(i) for i in range(40)], q, 7)
    best.most = 1000
    for at in range(0, 5000, 100):
        best.meet([str(i) for i in range(at, at + 100)], x[at : at + 100], np.arange(40))
        assert best.held <= 40 * 100 + 1000
    got = [tuple(r.values()) for b in best.hits(0) for r in b.to_pylist()]
    scores = np.round(q @ x.T, 6)
    expected = [(str(i), str(j), scores[i, j], 0) for i in range(40) for j in sorted(range(5000), key=lambda j: (-scores[i, j], str(j)))[:7]]
    assert got == expected


@pytest.mark.parametrize("parts", [1, 3])
def test_plain_search_broadcasts_nothing(spark, parts):
    passages = I.vectors(spark, SMALL).withColumn("block", I.F.pmod("vec_id", I.F.lit(3)).cast("int"))
    found = dense.topk(passages, I.vector_queries(spark, SMALL), 5, parts)
    assert found.count() == 5 * parts * I.vector_queries(spark, SMALL).count()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_query_and_block_are_no_rows(spark, monkeypatch):
    """What the search writes is a few rows a query, though no block can be left out."""
    sizes, keep = {}, pruned_dense.storage.kept
    monkeypatch.setattr(pruned_dense.storage, "kept", lambda df, path: sizes.setdefault(path.split("/")[-1], keep(df, path)))
    passages, queries = I.vectors(spark, SMALL), I.vector_queries(spark, SMALL)
    assert pruned_dense.topk(passages, queries, 5, block=8).count() == 5 * queries.count()
    blocks = sizes["blocks"].count()
    assert blocks > 40 and all(df.count() <= 6 * queries.count() for name, df in sizes.items() if not name.startswith("blocks"))
