import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>"


def exact(ids, x, queries, k=20):
    out = {}
    for q in queries:
        s = x @ x[ids.index(q)]
        best = sorted((-s[i], v) for i, v in enumerate(ids) if v != q)[:k]
        out[q] = [v for _, v in best]
    return out


def test_recall_and_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    got = hnsw.op7_neighbours(spark, sf_dir).collect()
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    ids = sorted(data)
    best = exact(ids, np.stack([data[i] for i in ids]), [i for i in ids if i % 20 == 0])
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - data[r["query_id"]] @ data[r["vec_id"]]) < 1e-12
    assert set(found) == set(best) and all(len(v) == 20 for v in found.values())
    assert np.mean([len(set(found[q]) & set(best[q])) / 20 for q in best]) >= 0.9


def test_unequal_norms_in_many_shards(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((1500, 12)) * rng.uniform(0.2, 3, (1500, 1))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = hnsw.nearest(rows, rows.filter("vec_id % 20 = 0"), shard_vectors=300).collect()
    best = exact(list(range(1500)), x.astype(float), range(0, 1500, 20))
    found = {q: {r["vec_id"] for r in got if r["query_id"] == q} for q in best}
    assert np.mean([len(found[q] & set(best[q])) / 20 for q in best]) >= 0.9


def test_equal_vectors_and_ties(spark):
    same = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.0, 1.0])]
    rows = spark.createDataFrame(same, SCHEMA)
    got = hnsw.nearest(rows, rows.filter("vec_id % 20 = 0")).collect()
    found = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20, 40, 100)}
    assert found[0] == list(range(1, 21)) and found[20] == list(range(20)) and found[40] == list(range(20))
    assert found[100] == list(range(20))


def test_odd_vectors(spark):
    odd = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (20, [2.0, 1.0]), (21, [-0.0, 1.0])]
    rows = spark.createDataFrame(odd, SCHEMA).withColumn("key", F.lit(1)).withColumn("rank", F.lit(2))
    got = hnsw.nearest(rows, rows.filter("vec_id % 20 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 20, 4.0), (0, 2, 21, 2.0), (20, 1, 0, 4.0), (20, 2, 21, 1.0)]
    none = rows.limit(0)
    assert hnsw.nearest(none, none).count() == 0 and hnsw.nearest(rows.filter("vec_id = 0"), rows.filter("vec_id = 0")).count() == 0


def test_graph_has_flat_arrays():
    x = np.random.default_rng(0).standard_normal((700, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, order = hnsw.Graph.build(x)
    assert sorted(order.tolist()) == list(range(700)) and graph.links[0].shape == (700, 32) and graph.sizes[0] == 700
    assert all((links < n).all() for links, n in zip(graph.links, graph.sizes))
    assert (graph.search(x[order], 8)[:, 0] == np.arange(700)).mean() > 0.99
