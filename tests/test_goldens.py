"""Hand-computed results: metrics, subset fold, splitter, query builders, statistics, prompts and parsing."""

import json
import math

import pytest
from pyspark.sql import functions as F

from larkspur import schemas
from larkspur.functions import outputs, prompts, text
from larkspur.operators import dense, dialogue, evaluation, indexing, lexical, ports
from larkspur.sources import readers, writers
from larkspur.streaming import responses


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_metrics_with_a_tie(spark):
    qrels = spark.createDataFrame([("q", "d1", 2), ("q", "d2", 0), ("q", "d3", 1), ("q", "d4", 3)], "qid string, pid string, rel int").withColumn("hit", (F.col("rel") >= 1).cast("int"))
    run = spark.createDataFrame([("q", "d3", 0.9), ("q", "d2", 0.8), ("q", "d1", 0.7), ("q", "d5", 0.7), ("other", "d1", 1.0)], "qid string, pid string, score double")
    (row,) = evaluation.per_query(run, qrels).collect()
    expected = {"map": 0.5, "recip_rank": 1.0, "P_20": 0.1, "recall_5": 2 / 3, "ndcg_cut_3": 0.2100020, "ndcg_cut_5": 0.3908879}
    for name, x in expected.items():
        assert row[name] == pytest.approx(x, abs=1e-6), name


@pytest.mark.parametrize("unjudged, kept", [(set(), {"9-1-1", "9-1-2", "9-1-4", "9-2-1"}), ({"9-1-1"}, {"9-1-2", "9-1-4", "9-2-1"})])
def test_corrected_subset(spark, unjudged, kept):
    rows = [("9-1", 1, [5]), ("9-1", 2, [2]), ("9-1", 3, [5, 7]), ("9-1", 4, [7]), ("9-1", 5, []), ("9-2", 1, [5])]
    turns = spark.createDataFrame([(n, p, f"{n}-{p}", prov) for n, p, prov in rows], "number string, pos int, sample_id string, ptkb_provenance array<int>")
    ids = turns.filter(~F.col("sample_id").isin(*(unjudged or {"none"}))).select(F.col("sample_id").alias("qid"))
    assert {r["sample_id"] for r in dialogue.corrected_subset(turns, ids).collect()} == kept


@pytest.mark.parametrize(
    "rewrite, queries",
    [
        ("1. What is A?\n2. What is B?", ["What is A?", "What is B?"]),
        ('"best phones", cheap phones, best phones', ["best phones", "cheap phones"]),
        ("What is A? tell me more", ["What is A?", "tell me more?"]),
        ("GPA 3.5 requirements", ["GPA 5 requirements"]),
        ("a,b,c,d,e,f", ["a", "b", "c", "d", "e"]),
        (" \n ", []),
        ("Is it 2.0? Is it 2.0?", ["Is it 0?"]),
    ],
)
def test_split_rewrite(spark, rewrite, queries):
    assert value(spark, text.split_rewrite(F.lit(rewrite))) == queries


@pytest.mark.parametrize("rewrite, response, c, query", [("a b", "one two three four five", 1, "a ba bone two three four five"), ("a b", "x", 1, "x"), ("a b c", "w w w w w w w", 1, "a b ca b cw w w w w w w"), ("a b", "w w w w w w", 2, "a ba bw w w w w w"), ("", "w", 1, None)])
def test_concat_auto(spark, rewrite, response, c, query):
    rows = spark.createDataFrame([("q", rewrite, response)], "sample_id string, rewrite_utt_text string, response_utt_text string")
    got = lexical.build_queries(rows.withColumn("oracle_utt_text", F.lit("")), "concat_auto", c=c).collect()
    assert [r["query"] for r in got] == ([query] if query is not None else [])


def test_unknown_query_type_is_an_error(spark):
    with pytest.raises(ValueError):
        lexical.build_queries(spark.createDataFrame([("q", "a", "b", "c")], "sample_id string, rewrite_utt_text string, response_utt_text string, oracle_utt_text string"), "nothing")


def test_run_statistics(spark):
    row = evaluation.run_statistics(spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 8.0)], "value double")).first()
    assert (row["min"], row["max"], row["mean"], row["median"]) == (1, 8, 3.75, 3)
    assert row["variance"] == pytest.approx(7.1875) and row["std"] == pytest.approx(2.680951, abs=1e-6)


def test_t_probability(spark):
    assert value(spark, evaluation.t_probability(F.lit(2.306), 8)) == pytest.approx(0.05, abs=1e-4)
    assert value(spark, evaluation.t_probability(F.lit(-7.379469), 8)) == pytest.approx(0.000078, abs=1e-6)
    flat = spark.createDataFrame([(i, f"m{i}", "s", "MAP", float(i), 0.0) for i in range(2)], "position int, name string, subset string, metric string, mean double, std double")
    assert evaluation.t_tests(flat).first()["p"] is None and evaluation.significant(evaluation.t_tests(flat)).count() == 0


def test_numbers_and_ids(spark):
    for given, numbers in (("5, 4, 2", "5 4 2"), ("[2, 4, 5, 6]", "2 4 5 6"), ("$1, $8, $9, $10", "1 8 9 10"), ("None", "")):
        assert value(spark, text.extract_numbers(F.lit(given))) == numbers.split()
    ids = spark.createDataFrame([("9-1-3",)], "qid string")
    asked = spark.createDataFrame([("9-1-3",), ("9-1-3-2",), ("9-1-4",)], "qid string")
    assert {r["qid"] for r in dialogue.relevant(asked, ids).collect()} == {"9-1-3", "9-1-3-2"}
    assert value(spark, text.normalise_qid(F.lit("9_1-3"))) == "9-1-3"
    assert (value(spark, text.base_id(F.lit("9-1-3-2"))), value(spark, text.last_segment(F.lit("9-1-3-2")))) == ("9-1-3", "2")


def test_answers(spark):
    assert tuple(value(spark, outputs.parse_prompt1(F.lit("Response: a\nb Queries: c")))) == ("c", "a\nb")
    assert tuple(value(spark, outputs.parse_sar_batch(F.lit("Provenance: 1\nRewrite: r\nResponse: s")))) == ("1", "r", "s")
    one_line = F.lit("Provenance: 1 Rewrite: r Response: s")
    assert value(spark, outputs.parse_sar_batch(one_line)) is None
    assert tuple(value(spark, outputs.parse_sar(one_line))) == (" r ", "s")
    assert value(spark, outputs.parse_selection(F.lit("nothing"))) == "None" and value(spark, outputs.parse_selection(F.lit("nothing"), batch=True)) is None


def test_dict_texts(spark):
    facts = F.array(F.struct(F.lit("1").alias("idx"), F.lit("I live here.").alias("fact")), F.struct(F.lit("2").alias("idx"), F.lit("I'm 26.").alias("fact")))
    assert value(spark, prompts.facts_repr(facts)) == str({"1": "I live here.", "2": "I'm 26."})
    for s in ('say "x" isn\'t', "plain", "it's", 'a "b"', "line\nend\\"):
        assert value(spark, prompts.text_repr(F.lit(s))) == repr(s)


def test_padding(spark):
    ids, short = F.array(*map(F.lit, [1, 2, 3, 4, 5])), F.array(F.lit(1), F.lit(2))
    assert value(spark, text.pad_query(ids, 3)) == [3, 4, 5] and value(spark, text.pad_passage(ids, 3)) == [1, 2, 3]
    assert value(spark, text.pad_query(short, 3)) == value(spark, text.pad_passage(short, 3)) == [1, 2, 0]
    assert value(spark, text.pad_passage(short, 3, left=True)) == [0, 1, 2]
    assert value(spark, text.attention_mask(short, 3)) == [1, 1, 0] and value(spark, text.token_types(2, True)) == [1, 1]


def test_best_fact(spark):
    metrics = spark.createDataFrame([("q", "0", 0.9), ("q", "1", 0.5), ("q", "2", 0.5), ("z", "0", 0.1)], "qid string, ptkb string, ndcg_cut_3 double")
    seen = spark.createDataFrame([("1", 0), ("0", 1), ("2", 2)], "ptkb string, first_seen long")
    pick = lambda always: {(r["qid"], r["ptkb"]) for r in evaluation.best_fact(metrics, seen, always).collect()}
    assert pick(False) == {("q", "0"), ("z", "0")} and pick(True) == {("q", "1")}


def test_context_starts_anew(spark, tmp_path):
    topics = [{"number": 1, "title": "t", "ptkb": {"1": "a"}, "turns": [{"turn_id": 1, "utterance": "u1", "resolved_utterance": "o1", "response": "r1", "ptkb_provenance": [1], "response_provenance": []}, {"turn_id": 2, "utterance": "u2", "resolved_utterance": "o2", "response": "r2", "ptkb_provenance": [], "response_provenance": []}]}]
    (tmp_path / "topics.json").write_text(json.dumps(topics))
    flat = dialogue.flatten(readers.topics(spark, str(tmp_path / "topics.json")))
    rows = {r["sample_id"]: (r["ctx_utts_text"], r["history_response"], r["ptkb"]) for r in flat.collect()}
    assert rows == {"1-1": ([], [], {"1": "a"}), "1-2": (["u1"], ["r1"], {"1": "a"})}
    assert [r["sample_id"] for r in dialogue.flatten(readers.topics(spark, str(tmp_path / "topics.json")), only_facts=True).collect()] == ["1-1"]
    writers.overwrite_json(flat, str(tmp_path / "flat"))
    writers.append_json(flat, str(tmp_path / "flat"))
    assert readers.turns(spark, str(tmp_path / "flat")).count() == 4


def test_text_files(spark, tmp_path):
    (tmp_path / "qrels.txt").write_text("1_1 0 d1 1\n1_1 0 d1 2\nshort line\n1-2 0 d2 0\n")
    lines = readers.numbered_lines(spark, str(tmp_path / "qrels.txt"))
    assert {tuple(r) for r in readers.qrels(lines).collect()} == {("1-1", "d1", 2, 1), ("1-2", "d2", 0, 0)}
    assert {r["qid"] for r in readers.assessed_ids(lines).collect()} == {"1-1", "1-2"}
    run = spark.createDataFrame([("1-1", "d1", 1, 2.5), ("1-1", "d2", 2, 1.5)], "qid string, pid string, rank int, score double")
    writers.write_run(run, str(tmp_path / "run"), "bm25", seven=True)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "run")).collect()) == ["1-1 Q0 d1 1 199 2.5 bm25", "1-1 Q0 d2 2 198 1.5 bm25"]
    writers.write_run(run, str(tmp_path / "dense"), "dense", underscores=True)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "dense")).collect())[0] == "1_1 Q0 d1 1 2.5 dense"
    back = readers.run(readers.numbered_lines(spark, str(tmp_path / "dense")))
    assert {(r["pid"], r["score"]) for r in back.collect()} == {("d1", 2.5), ("d2", 1.5)}


def test_passages_and_records(spark, tmp_path):
    lines = spark.createDataFrame([('{"id": "a", "contents": "text  "}',), ("",), ("{bad",), ("[1]",)], "value string")
    assert [tuple(r) for r in readers.passages_json(lines).collect()] == [("a", "text")]
    rows = spark.createDataFrame([("p1\tbody\ttitle [SEP] two",), ("p2",)], "value string")
    assert [tuple(r) for r in readers.passages_tsv(rows, title=True).collect()] == [("p1", "title two body")]
    assert [tuple(r) for r in readers.passages_tsv(rows).collect()] == [("p1", "body")]
    records = spark.createDataFrame([("a", 0, [1]), ("b", 1, [1, 2, 3])], "pid string, offset long, ids array<int>")
    fixed = indexing.token_records(records, 2)
    assert indexing.wrong_widths(fixed, 2).count() == 0 and indexing.wrong_widths(fixed, 3).count() == 2
    assert sorted(r["offset"] for r in indexing.shuffled_order(fixed, 3).collect()) == [0, 1]
    writers.write_collection(fixed, str(tmp_path / "records"), 1)
    assert spark.read.parquet(str(tmp_path / "records")).count() == 2


def test_record_fallbacks(spark):
    lines = spark.createDataFrame([(0, '{"sample_id": "s", "rewrite_utt_text": "r", "oracle_utt_text": "o"}'), (1, '{"id": "i", "output": "x", "oracle_utt_text": "o"}')], "line_no long, value string")
    assert {tuple(r) for r in readers.with_fallbacks(readers.json_rows(lines, schemas.FLAT_TURN)).collect()} == {("s", "r"), ("i", "x")}


def test_row_index_over_many_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = indexing.row_index(rows, "x", per_range=50)
    assert all(r["x"] == r["row_no"] for r in got.collect())
    whole = indexing.offsets(got.filter("row_no < 1000"), 32)
    order = sorted(range(1000), key=lambda i: (i % 32, i))
    assert {r["row_no"]: r["offset"] for r in whole.collect()} == {i: at for at, i in enumerate(order)}
    sizes = {r["block"]: r["count"] for r in indexing.array_split(got, 7).groupBy("block").count().collect()}
    assert [sizes[b] for b in range(7)] == [143] * 6 + [142]


def test_registry_and_runs(spark):
    runs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2)], "base string, run int")
    assert {(r["base"], r["next_run"]) for r in writers.next_run(runs).collect()} == {("a", 3), ("b", 1)}
    assert [r["base"] for r in writers.complete_runs(runs, 2).collect()] == ["a"]
    old = spark.createDataFrame([("f", "1"), ("g", "2")], "filename string, batch_id string")
    assert {tuple(r) for r in writers.upsert(old, spark.createDataFrame([("g", "3")], old.schema)).collect()} == {("f", "1"), ("g", "3")}


def test_ports(spark):
    calls = []

    def flaky(system, content):
        calls.append(content)
        if len(calls) < 3:
            raise ports.RateLimited if len(calls) == 1 else RuntimeError
        return content.upper()

    waits = []
    assert ports.with_retries(flaky, sleep=waits.append)("s", "x") == "X" and waits == [60.0, 2.0, 2.0]

    def provider():
        def chat(system, content):
            if content == "bad":
                raise RuntimeError
            return f"{system}:{content}"

        return chat

    rows = spark.createDataFrame([("a",), ("bad",), (None,)], "prompt string")
    assert [r["answer"] for r in ports.query_model(rows, "prompt", "s", provider).collect()] == ["s:a", None, None]

    class Client:
        done, cancelled = [], []

        def finished(self, batch_id):
            return batch_id != "3"

        def fetch(self, batch_id, path):
            self.done.append(path)

        def cancel(self, batch_id):
            self.cancelled.append(batch_id)

    client, registry = Client(), {"SAR_a": "1", "other": "2", "SAR_b": "3", "SAR_c": "4"}
    assert ports.collect_batches(registry, client, "out", "SAR", exists=lambda p: p.endswith("c")) == ["out/SAR_a"]
    ports.cancel_batches(registry, client)
    assert client.cancelled == ["1", "2", "3", "4"]


def test_answers_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda i, c: json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": c}}]}}})
    (folder / "a.json").write_text("\n".join([line("1", "x"), line("1", "x"), line("2", "")]))
    for _ in range(2):
        responses.land(responses.answers(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        (folder / "b.json").write_text("\n".join([line("1", "again"), line("3", "y")]))
    assert sorted(r["custom_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "3"]


def test_dense_blocks_agree_with_numpy(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((300, 8))
    rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "pid string, vector array<double>")
    asked = rows.filter("cast(pid as int) % 50 = 0").withColumnRenamed("pid", "qid")
    got = {(r["qid"], r["rank"]): r["pid"] for r in dense.topk(rows, asked, 5).collect()}
    for q in range(0, 300, 50):
        best = np.argsort(-np.round(x @ x[q], 6), kind="stable")[:5]
        assert [got[str(q), k + 1] for k in range(5)] == [str(i) for i in best]
    mean = dense.masked_mean(F.array(F.array(F.lit(1.0)), F.array(F.lit(3.0))), F.array(F.lit(0), F.lit(0)))
    assert value(spark, mean) is None and math.isclose(value(spark, dense.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))), 11)
