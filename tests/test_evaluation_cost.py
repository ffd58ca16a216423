"""Evaluation reads and cuts what it is given once."""

import math

import pytest

from larkspur.operators import evaluation
from larkspur.sources import readers


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_judgement_lines_are_cut_once(spark):
    lines = spark.range(4000).selectExpr("id AS line_no", "concat('q', id % 5, '  0 d', id, '\t', id % 4 - 1, ' ') AS value")
    run = spark.range(200).selectExpr("concat('q', id % 5) AS qid", "concat('d', id) AS pid", "cast(id AS double) AS score")
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            plan = final_plan(evaluation.per_query(run, readers.qrels(lines)))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert plan.count("regexp_") == 1


def test_both_sides_of_a_test_come_from_one_pass(spark):
    stats = spark.range(12).selectExpr("id % 4 AS position", "concat('n', id % 4) AS name", "concat('s', id DIV 4) AS subset", "'MAP' AS metric", "cast(id AS double) AS mean", "1D AS std")
    tests = evaluation.t_tests(stats.groupBy("position", "name", "subset", "metric").agg({"mean": "max", "std": "max"}).toDF("position", "name", "subset", "metric", "mean", "std"))
    assert final_plan(tests).count("Range (") == 1
    assert sorted((r["name1"], r["name2"]) for r in tests.filter("subset = 's1'").collect()) == [(f"n{i}", f"n{j}") for i in range(4) for j in range(i + 1, 4)]


def test_best_order_from_counts_of_grades(spark):
    """More judgements than the deepest cut, negative and null grades."""
    grades = [(("q", f"d{i:04d}", None if i % 7 == 0 else i % 5 - 1)) for i in range(1500)] + [("r", "d0000", 2), ("s", "d0000", None)]
    qrels = spark.createDataFrame(grades, "qid string, pid string, rel int").selectExpr("*", "cast(coalesce(rel, 0) >= 1 AS int) AS hit")
    run = spark.createDataFrame([("q", f"d{i:04d}", float(i)) for i in range(0, 1500, 3)] + [("r", "d0000", 1.0), ("s", "d0000", 1.0)], "qid string, pid string, score double")
    got = {r["qid"]: r for r in evaluation.per_query(run, qrels).collect()}
    gains = {p: max(g or 0, 0) for q, p, g in grades if q == "q"}
    best, mine = sorted(gains.values(), reverse=True), [gains[f"d{i:04d}"] for i in sorted(range(0, 1500, 3), reverse=True)]
    dcg = lambda x, k: sum(g / math.log2(i + 2) for i, g in enumerate(x[:k]))
    for k in (3, 5, 1000):
        assert got["q"][f"ndcg_cut_{k}"] == pytest.approx(dcg(mine, k) / dcg(best, k), abs=1e-12)
        assert got["r"][f"ndcg_cut_{k}"] == 1 and got["s"][f"ndcg_cut_{k}"] == 0
