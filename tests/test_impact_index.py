"""The segmented index against the plain search over all passages."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import lexical, storage
from larkspur.operators.impact_index import ImpactIndex
from larkspur.plans import standins as I

SMALL = "/root/testdata/sf0.01"


def rows(df):
    return sorted((r["qid"], r["pid"], round(r["score"], 5), r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def passages(spark):
    return I.passages(spark, SMALL)


@pytest.fixture(scope="module")
def questions(spark):
    return I.questions(spark, SMALL)


@pytest.fixture(scope="module")
def index(spark, passages, tmp_path_factory):
    made = ImpactIndex(spark, f"file://{tmp_path_factory.mktemp('index')}", buckets=4, block=16, shard=200)
    made.add(passages.filter("cast(pid as int) % 3 = 0"))
    made.add(passages.filter("cast(pid as int) % 3 > 0"))
    return made


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_same_rows_as_the_plain_search(index, passages, questions, k):
    report: dict = {}
    assert rows(index.search(questions, k, report=report)) == rows(lexical.search(passages, questions, k))
    assert report["scored"] <= report["pairs"] and report["rounds"] >= 1


def test_most_blocks_of_short_queries_are_not_scored(index, passages, questions):
    """Whole benchmark passages as queries have few words that matter more than others, so the first words stand for queries."""
    short = questions.select("qid", F.array_join(F.slice(F.split("query", r"\s+"), 1, 8), " ").alias("query"))
    shares = []
    for k in (1, 10):
        report: dict = {}
        assert rows(index.search(short, k, report=report)) == rows(lexical.search(passages, short, k))
        assert report["read"] <= report["blocks"] and report["scored"] <= report["pairs"]
        shares.append(report["scored"] / report["pairs"])
    assert shares[0] < 0.6 and shares[0] < shares[1] < 1


def test_other_parameters_than_those_it_was_built_with(index, passages, questions):
    few = questions.limit(5)
    assert rows(index.search(few, 20, k1=1.5, b=0.2)) == rows(lexical.search(passages, few, 20, k1=1.5, b=0.2))


def test_two_deliveries_and_a_merge_equal_one_build(spark, index, passages, questions, tmp_path):
    few = questions.limit(8)
    one = ImpactIndex(spark, f"file://{tmp_path}/one", buckets=4, block=16, shard=200)
    one.add(passages)
    assert rows(one.search(few, 50)) == rows(index.search(few, 50))
    two = ImpactIndex(spark, f"file://{tmp_path}/two", buckets=4, block=16, shard=200)
    first, second = two.add(passages.filter("cast(pid as int) % 2 = 0")), two.add(passages.filter("cast(pid as int) % 2 = 1"))
    merged = two.merge()
    assert [s["id"] for s in two.segments()] == [merged] and two.segments()[0]["n"] == one.segments()[0]["n"] and two.segments()[0]["words"] == one.segments()[0]["words"]
    content = lambda x: sorted(map(str, x._blocks(x.segments()).drop("segment").collect()))
    assert content(two) == content(one)
    assert two.prune() == sorted([first, second])
    assert rows(two.search(few, 50)) == rows(one.search(few, 50))


def test_a_failed_delivery_leaves_the_index_as_it_was(spark, tmp_path):
    make = lambda *r: spark.createDataFrame(list(r), "pid string, text string")
    asked = spark.createDataFrame([("q", "red fish")], "qid string, query string")
    index = ImpactIndex(spark, f"file://{tmp_path}/i", buckets=2)
    index.add(make(("a", "red fish blue fish"), ("b", None), ("c", "")))
    before = rows(index.search(asked))
    broken = make(("d", "red")).withColumn("text", F.when(F.raise_error(F.lit("no")).isNull(), F.col("text")))
    with pytest.raises(Exception, match="no"):
        index.add(broken)
    assert rows(index.search(asked)) == before == [("q", "a", before[0][2], 1)]
    # a writer that began from an older state comes too late
    with pytest.raises(RuntimeError, match="another writer"):
        index._commit(0, [])
    # a state that is only half written does not count
    number, state = index.manifest.last()
    storage.create(spark, f"{index.path}/manifest/{number + 1:08d}.json", json.dumps(state).encode()[:20])
    assert index.manifest.last() == (number, state) and rows(index.search(asked)) == before


def test_empty_indexes_and_queries(spark, tmp_path):
    index = ImpactIndex(spark, f"file://{tmp_path}/i", buckets=2)
    asked = spark.createDataFrame([("q", "red"), ("r", None), ("s", "nowhere")], "qid string, query string")
    assert index.search(asked).count() == 0
    index.add(spark.createDataFrame([], "pid string, text string"))
    assert index.search(asked).count() == 0
    index.add(spark.createDataFrame([("a", "red red"), ("b", "red"), ("c", "blue")], "pid string, text string"))
    assert [(r[0], r[1]) for r in rows(index.search(asked))] == [("q", "a"), ("q", "b")]
    assert index.search(asked.limit(0)).count() == 0


def test_no_row_for_each_passage_query_and_term(spark, index, questions, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch", lambda session, label: f"file://{tmp_path}/{label}")
    index.search(questions, 5).count()
    terms = lexical.query_terms(questions).select("term").distinct()
    held = index._blocks(index.segments()).join(terms, "term", "left_semi").agg(F.sum(F.size("pids"))).first()[0]
    written = sum(spark.read.parquet(f"file://{p}").count() for p in (tmp_path / "search").iterdir() if p.name in ("hits", "postings"))
    assert 0 < written <= held


def test_many_queries_go_in_groups(index, passages, questions, monkeypatch):
    few = questions.limit(2)
    whole = rows(lexical.search(passages, few, 10))
    monkeypatch.setattr(lexical, "MOST_HITS", 10)
    assert rows(index.search(few, 10)) == whole and len(whole) == 20
