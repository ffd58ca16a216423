"""What a task of a BM25 search holds."""

import re

import pytest

from larkspur.operators import lexical


@pytest.fixture
def passages(spark):
    return spark.createDataFrame([(str(i), " ".join(f"w{i * j % 97} w{j}" for j in range(1, 60))) for i in range(400)], "pid string, text string")


def test_parts_follow_the_text(spark, passages, monkeypatch):
    monkeypatch.setattr(lexical, "CHARACTERS", 5_000)
    parts = [(p, len(t)) for p, t in passages.rdd.map(lambda r: (0, r["text"])).collect()]
    found = lexical.dealt(passages)
    assert found.rdd.getNumPartitions() == -(-sum(n for _, n in parts) // 5_000) > 20
    assert max(found.rdd.mapPartitions(lambda rows: [sum(len(r["text"]) for r in rows)]).collect()) < 25_000


def test_same_rows_for_any_parts_and_joins(spark, passages, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()))
    asked = spark.createDataFrame([("a", "w1 w2 w2 w50"), ("b", "w3"), ("c", "none")], "qid string, query string")
    once, counts = rows(lexical.search(passages, asked, 7)), rows(lexical.postings(passages))
    monkeypatch.setattr(lexical, "CHARACTERS", 5_000)
    monkeypatch.setattr(lexical, "MOST_TERMS", 1)
    assert rows(lexical.search(passages, asked, 7)) == once and rows(lexical.postings(passages)) == counts and len(once) == 14


def test_only_k_rows_a_query_of_each_part_are_shuffled(spark, passages):
    """Counts are summed up by query and passage where the text is: no exchange by term, none by (qid, pid)."""
    asked = spark.createDataFrame([("a", "w1 w2"), ("b", "w3")], "qid string, query string")
    found = lexical.search(passages, asked, 5)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" in plan and not re.search(r"hashpartitioning\((qid#\w+, pid#|pid#\w+, qid#)", plan)


def test_texts_are_cut_once_and_scored_in_blocks(spark, passages, monkeypatch):
    """Counts are written once and scored without a row for each passage, term and query."""
    asked = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1} w{i + 1} w7") for i in range(30)], "qid string, query string")
    found = lexical.search(passages, asked, 6)
    found.collect()
    assert "regexp_" not in found._jdf.queryExecution().executedPlan().toString()
    few = sorted(map(tuple, found.collect()))
    for name, least in (("SUMS", 70), ("SUMS", 1)):  # other blocks, the same rows
        monkeypatch.setattr(lexical, name, least)
        assert sorted(map(tuple, lexical.search(passages, asked, 6).collect())) == few
    monkeypatch.setattr(lexical, "MOST_HITS", 1)  # joined by a shuffle
    assert sorted(map(tuple, lexical.search(passages, asked, 6).collect())) == few and len(few) == 180


def test_odd_ids_and_copies(spark, monkeypatch):
    """Ids of other types, null ids, repeated ids, ties by id, a query's terms that no passage has."""
    passages = spark.createDataFrame([(2, "red fish"), (1, "fish red"), (None, "red fish"), (3, "red"), (3, "red red fish"), (3, "red"), (4, None), (5, "")], "pid long, text string")
    asked = spark.createDataFrame([(7, "red fish nowhere"), (8, "fish"), (None, "red"), (9, "nowhere")], "qid int, query string")
    rows = lambda k: sorted(map(str, lexical.search(passages, asked, k).collect()))
    few = [rows(k) for k in (1, 2, 10)]
    monkeypatch.setattr(lexical, "MOST_TERMS", 1)
    assert few == [rows(k) for k in (1, 2, 10)] and [len(x) for x in few] == [3, 6, 12]
