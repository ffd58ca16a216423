import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import quality
from tests.llm.conftest import ROWS


def test_held_out_accuracy(spark, sf_dir):
    rows = {r["doc_id"]: r for r in quality.op2_quality(spark, sf_dir.replace("sf0.001", "sf0.1")).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/labels.parquet").collect()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(labels[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and labels.get(i) is not None]
    good, bad = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_votes_are_those_of_brute_force():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd!!", "ee$$"], 30)) for _ in range(80)]
    counts, labels = np.stack([quality.terms(t) for t in texts]), rng.integers(0, 2, 80)
    keys = np.array([quality.text_key(t) for t in texts], np.uint64)
    voters = quality.Voters.fit(counts, labels, keys, axes=8, neighbours=5)
    asked = [" ".join(rng.choice(["aa", "bb", "ee$$", "zz"], 20)) for _ in range(10)] + texts[:5]
    new = np.stack([quality.terms(t) for t in asked])
    z = quality.Voters.weigh(new, voters.idf) @ voters.axes
    for text, row, got in zip(asked, z, voters.score(new, np.array([quality.text_key(t) for t in asked], np.uint64))):
        near = np.where([t == text for t in texts], -1, voters.vectors @ (row / np.linalg.norm(row)))
        best = np.argsort(-near)[:5]
        weight = np.maximum(near[best].astype(float), 0) ** 8
        assert abs(got - (weight * labels[best]).sum() / weight.sum()) < 1e-5
    u, s, vt = np.linalg.svd(quality.Voters.weigh(counts, voters.idf), full_matrices=False)
    assert np.linalg.norm(voters.axes.T @ vt[:4].T) > 1.99  # the leading directions are found


def test_labels_are_bounded_and_repeatable(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = (quality.fit(documents.repartition(n), labels, sample=30) for n in (1, 6))
    assert len(a.labels) == 30 and np.allclose(a.vectors, b.vectors, atol=1e-5)


def test_fitting_holds_one_term_matrix(spark, sf_dir):
    """The driver needs little besides the matrix of the sample, which a copy of it or two would not leave room for."""
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    tracemalloc.start()
    try:
        voters = quality.fit(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 1.75 * len(voters.labels) * (quality.TERMS + quality.EXTRA) * 4


def test_counts_stay_unless_given_away():
    counts = np.stack([quality.terms(f"text {i} of {i % 7} words " * 9) for i in range(600)])
    was, labels, keys = counts.copy(), np.arange(600) % 2, np.arange(600, dtype=np.uint64)
    kept = quality.Voters.fit(counts, labels, keys)
    assert (counts == was).all()
    given = quality.Voters.fit(counts, labels, keys, own=True)
    assert (kept.vectors == given.vectors).all() and (kept.axes == given.axes).all() and (kept.idf == given.idf).all()
    z = np.log1p(was[:, : quality.TERMS]) * kept.idf
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    assert (quality.Voters.weigh(was, kept.idf) == np.concatenate([z, was[:, quality.TERMS :]], 1)).all()


def test_no_row_votes_for_itself(spark, documents):
    """With labels that say nothing, rows labelled 1 and 0 score alike."""
    labels = documents.select("doc_id", (F.xxhash64("doc_id", F.lit(5)) % 2 == 0).cast("int").alias("quality"))
    rows = quality.score(documents.join(labels, "doc_id").select("doc_id", "text", "quality"), quality.fit(documents, labels)).collect()
    one, zero = ([r["_score"] for r in rows if r["quality"] == y] for y in (1, 0))
    assert abs(np.mean(one) - np.mean(zero)) < 4 * (np.var(one) / len(one) + np.var(zero) / len(zero)) ** 0.5
    assert max(abs(r["_score"] - r["quality"]) for r in rows) > 0.3


def test_ids_with_many_rows_are_one_voter_each(spark):
    rows = spark.createDataFrame([(i, f"text {j} of {i} " * 5) for i in range(10) for j in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    a, b = (quality.fit(rows.repartition(n), labels, sample=10) for n in (1, 7))
    assert len(a.labels) == 10 and sorted(a.labels) == [0] * 5 + [1] * 5 and (a.keys == b.keys).all() and np.allclose(a.vectors, b.vectors, atol=1e-5)


def test_the_query_is_that_of_brute_force(spark, sf_dir, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    counts = np.stack([quality.terms(texts[i]) for i in sorted(known, key=str)])
    y = np.array([known[i] for i in sorted(known, key=str)], float)
    voters = quality.Voters.fit(counts, y, np.array([quality.text_key(texts[i]) for i in sorted(known, key=str)], np.uint64))
    for r in quality.op2_quality(spark, sf_dir).collect():
        z = quality.Voters.weigh(quality.terms(texts[r["doc_id"]])[None], voters.idf)[0] @ voters.axes
        near = np.where([texts[i] == texts[r["doc_id"]] for i in sorted(known, key=str)], -1, voters.vectors @ (z / max(np.linalg.norm(z), 1e-9)))
        best = np.argsort(-near)[:15]
        weight = np.maximum(near[best].astype(float), 0) ** 8
        assert abs(r["score"] - (weight @ y[best] / weight.sum() if weight.sum() > 1e-12 else y.mean())) < 2e-3


def test_odd_rows(spark, odd, none, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    voters = quality.fit(documents, labels.unionByName(labels.limit(2).withColumn("quality", F.lit(None).cast("int"))))
    scored = quality.score(odd.select("doc_id", "text"), voters).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["_score"] <= 1 for r in scored)
    assert quality.score(none, voters).count() == 0
    unlabelled = quality.fit(documents, labels.limit(0))
    assert {r["_score"] for r in quality.score(odd.select("doc_id", "text"), unlabelled).collect()} == {0.5}
    kept = quality.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == len(ROWS)
