import math
import os

import numpy as np
import pytest

from larkspur.llm import whitening
from larkspur.llm.whitening import Moments, Whitening, merged

SCHEMA = "vec_id long, embedding array<float>, label int, x int, component string, n int"


def plain(rows, components=4):
    """(vec_id, component) -> (n, deviation, whitened, explained), by numpy over all vectors at once."""
    whole = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(x) for _, x in whole}), np.float64)
    n, sums = len(distinct), [int(s) for s in distinct.sum(0)]
    centred = distinct - distinct.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in whole:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(components):
            axis, value = axes[:, -1 - k], values[-1 - k]
            out[i, k + 1] = (n, deviation, float((np.array(x) - distinct.mean(0)) @ axis / math.sqrt(value)), float(value / values.sum()))
    return out


def same(got, expected):
    assert len(got) == len(expected)
    signs = {}
    for r in got:
        n, deviation, white, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] - explained) < 1e-9 and r["identity_error"] < 1e-9
        if abs(white) > 1e-3:
            signs.setdefault(r["component"], set()).add(np.sign(white) == np.sign(r["whitened"]))
        assert abs(abs(r["whitened"]) - abs(white)) < 1e-6
    assert all(len(s) == 1 for s in signs.values())
    assert len({r["identity_error"] for r in got}) <= 1


def test_query_equals_numpy_over_the_whole_table(spark, sf_dir):
    got = whitening.op13_whitening(spark, sf_dir)
    assert [f"{c} {t}" for c, t in got.dtypes] == ["vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    same(got.collect(), plain(rows))


def test_partitions_do_not_matter(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one, many = (whitening.whitened(table.repartition(k)).orderBy("vec_id", "component").collect() for k in (1, 40))
    assert [r[:4] for r in one] == [r[:4] for r in many]
    assert np.allclose([r["whitened"] for r in one], [r["whitened"] for r in many], atol=1e-9)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(60)]
    vectors += [(100 + i, vectors[0][1]) for i in range(40)] + [(7, vectors[7][1]), (200, [0.0, -0.0, 1e-9, -1e-9, 2.0])]
    bad = [(300, None), (301, [1.0, None, 2.0, 0.0, 0.0]), (302, [1.0, float("nan"), 2.0, 0.0, 0.0]), (303, [float("inf"), 1.0, 0.0, 0.0, 0.0]), (304, []), (305, [1.0, 2.0]), (306, [])]
    more = (1, "c", 2)
    spark.createDataFrame([(*v, 0, *more) for v in vectors + bad], SCHEMA).repartition(3).write.parquet(os.path.join(tmp_path, "embeddings.parquet"))
    got = whitening.op13_whitening(spark, str(tmp_path)).collect()
    expected = plain(vectors)
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, k) for i, _ in vectors for k in (1, 2, 3, 4))
    once = {(r["vec_id"], r["component"]): r for r in got}
    same(list(once.values()), expected)


@pytest.mark.parametrize(
    ("rows", "whitened"),
    [
        ([], []),
        ([(1, None), (2, [])], []),
        ([(1, [1.0, 2.0])], [None, None]),
        ([(1, [0.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], [-1.0, None, 1.0, None, 1.0, None]),
    ],
)
def test_few_rows_and_no_variance(spark, rows, whitened):
    got = whitening.whitened(spark.createDataFrame([(*r, 0, 1, "c", 2) for r in rows], SCHEMA)).collect()
    assert sorted(map(str, (r["whitened"] for r in got))) == sorted(map(str, whitened))
    assert all(r["identity_error"] is None for r in got if set(whitened) == {None})


def test_very_large_components_saturate(spark):
    got = whitening.whitened(spark.createDataFrame([(1, [3e38, 1.0], 0, 1, "c", 2), (2, [-3e38, 2.0], 0, 1, "c", 2), (3, [0.0, 1.0], 0, 1, "c", 2)], SCHEMA)).collect()
    assert {r["deviation"] for r in got if r["vec_id"] == 1} == {None}
    assert len(got) == 6


def test_merging_equals_moments_at_once():
    rng = np.random.default_rng(3)
    rows = rng.integers(-1000, 1000, (5000, 7)) + 10**6
    whole = Moments.of(rows)
    parts = [Moments.of(x) for x in np.array_split(rows, [1, 2, 500, 3000])]
    state: dict = {}
    for p in parts:
        state = merged(state, {7: p})
    assert state[7].n == 5000 and (state[7].sums == rows.sum(0)).all()
    assert np.allclose(state[7].covariance, np.cov(rows.T, bias=True), rtol=1e-12, atol=1e-8)
    assert np.allclose(whole.covariance, state[7].covariance, rtol=1e-12, atol=1e-8)
    assert merged({3: parts[0]}, {4: parts[1]}).keys() == {3, 4}


def test_deviations_beyond_64_bits_are_exact():
    rows = np.array([[2**40, 5], [-(2**40), 7]])
    white = Whitening.of(Moments.of(rows), 2)
    assert white.deviation(rows) == [None, None]
    rows = np.array([[2**29, 5], [-(2**29), 8]])
    white = Whitening.of(Moments.of(rows), 2)
    assert white.deviation(rows) == [2**60 + 9, 2**60 + 9]
