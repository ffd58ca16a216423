"""Encoder head, batch clients, checks of a collection, names, the stored index, and the commands over them."""

import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import cli, config
from larkspur.operators import dense, encoder, indexing, lexical, ports
from larkspur.sources import readers, writers


def head(mean):
    return encoder.Head(np.array([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0]]), np.array([0.0, 1.0, 0.0]), np.ones(3), np.full(3, 0.5), mean, 0.0)


def test_head():
    states, mask = np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]]), np.array([[1.0, 1.0, 0.0]])
    for mean, x in ((False, [1.0, 5.0, 3.0]), (True, [2.0, 7.0, 5.0])):
        x = np.array(x)
        assert np.allclose(head(mean)(states, mask), (x - x.mean()) / x.std() + 0.5)
    assert np.isfinite(encoder.Head(np.eye(2), np.zeros(2), np.ones(2), np.zeros(2), True)(states, np.zeros((1, 3)))).all()


def parts():
    return lambda texts: [[len(w) for w in t.split()] for t in texts], lambda ids, mask: np.stack([ids, ids * ids], -1).astype(float), head(True)


def test_text_encoder_has_no_effect_of_batches(spark):
    texts = ["a bb", "", "cc ddd eeee", "a"] * 40
    got = encoder.text_encoder(parts, at_once=7)()(texts)
    assert np.allclose(got, np.concatenate([encoder.text_encoder(parts)()([t]) for t in texts]))
    rows = spark.createDataFrame([(1, "a bb"), (2, None)], "k int, text string")
    vectors = {r["k"]: r["vector"] for r in dense.encode(rows, "text", encoder.text_encoder(parts)).collect()}
    assert np.allclose(vectors[1], got[0]) and np.allclose(vectors[2], got[1])


class Service(BaseHTTPRequestHandler):
    seen: list = []

    def log_message(self, *_):
        pass

    def answer(self, body):
        self.seen.append((self.command, self.path, self.headers["Authorization"]))
        self.send_response(200 if body is not None else 429)
        self.end_headers()
        self.wfile.write(body or b"")

    def do_GET(self):
        self.answer({"/v1/batches/b1": b'{"status": "completed", "output_file_id": "o1"}', "/v1/files/o1/content": b"lines\n"}.get(self.path))

    def do_POST(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        if self.path == "/v1/files":
            assert b'{"custom_id": 1}' in body and b'filename="ask.jsonl"' in body
        if self.path == "/v1/batches":
            assert json.loads(body)["completion_window"] == "24h" and json.loads(body)["input_file_id"] == "f1"
        self.answer({"/v1/files": b'{"id": "f1"}', "/v1/batches": b'{"id": "b1"}', "/v1/batches/b1/cancel": b"{}"}.get(self.path))


def test_http_batches(tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        (tmp_path / "ask.jsonl").write_text('{"custom_id": 1}\n')
        client = ports.HttpBatches(f"http://127.0.0.1:{server.server_port}", "key")
        registry = ports.BatchRegistry(str(tmp_path / "ids.json"))
        assert ports.submit_batch(str(tmp_path / "ask.jsonl"), client, registry) == "b1" and registry.read() == {"ask.jsonl": "b1"}
        assert client.finished("b1")
        client.fetch("b1", str(tmp_path / "got"))
        assert (tmp_path / "got").read_text() == "lines\n"
        client.cancel("b1")
        with pytest.raises(ports.RateLimited):
            client.status("unknown")
        assert Service.seen[-2] == ("POST", "/v1/batches/b1/cancel", "Bearer key")
    finally:
        server.shutdown()


def test_batch_commands_over_a_folder(spark, tmp_path, capsys):
    run = lambda *argv: cli.main([str(x) for x in argv], spark)
    for name in ("ask_a", "ask_b"):
        spark.range(3).select(F.concat(F.lit(name), F.col("id").cast("string")).alias("custom_id")).write.json(str(tmp_path / name))
        run("submit", "--input", tmp_path / name, "--folder", tmp_path / "box")
    ids = json.loads((tmp_path / "box" / "batch_ids.json").read_text())
    assert set(ids) == {"ask_a.jsonl", "ask_b.jsonl"}
    assert len((tmp_path / "box" / "requests" / f"{ids['ask_a.jsonl']}.jsonl").read_text().splitlines()) == 3
    (tmp_path / "box" / "answers" / f"{ids['ask_a.jsonl']}.jsonl").write_text("answer\n")
    run("cancel", "--folder", tmp_path / "box", "--pattern", "ask_b")
    run("status", "--folder", tmp_path / "box")
    shown = capsys.readouterr().out
    assert "ask_a.jsonl completed" in shown and "ask_b.jsonl cancelled" in shown
    assert [p.name for p in (tmp_path / "box" / "processed").iterdir()] == ["ask_a.jsonl"]


def test_providers_and_growing_waits():
    assert [ports.choose_provider(m, lambda m: "local " + m, lambda m: "remote " + m)() for m in ("meta-llama-3", "gpt")] == ["local meta-llama-3", "remote gpt"]
    waits, calls = [], []

    def parse(text):
        calls.append(text)
        if len(calls) < 3:
            raise ValueError
        return text

    assert ports.with_retries(parse, tries=3, wait=1.0, growth=2.0, sleep=waits.append)("x") == "x" and waits == [1.0, 2.0]


def test_names(spark):
    path = lambda source, **o: spark.range(1).select(writers.run_path(source, **o)).first()[0]
    folder = "data/results/trec_files"
    assert path("data/2023_q.jsonl", kind="ance_", split=True) == f"{folder}/2023/ance_2023_q_split.trec"
    assert path("q.jsonl", query_type="concat", test_type="full", tag="r1") == f"{folder}/q_qtype_concat_ttype_full_r1.trec"
    assert path("x/2024/q", kind="bm25_") == f"{folder}/2024/bm25_q.trec"
    part = lambda m: spark.range(1).select(writers.model_part(m, "usual")).first()[0]
    assert (part("usual"), part("meta/big"), part("gpt")) == ("", "_meta", "_gpt")


def test_numbers_in_a_name_are_no_year(spark):
    path = lambda source: spark.range(1).select(writers.run_path(source)).first()[0]
    folder = "data/results/trec_files"
    assert path("data/queries_2023.jsonl") == f"{folder}/queries_2023.trec"
    assert path("data/2024/queries_12023.jsonl") == f"{folder}/2024/queries_12023.trec"
    assert path("data/20240_q.jsonl") == f"{folder}/20240_q.trec" and path("2024_q.jsonl") == f"{folder}/2024/2024_q.trec"


def test_fields_and_blocks(spark):
    rows = spark.createDataFrame([("abc",), ("é" * 40,), (None,), ("",)], "pid string")
    field = indexing.pid_field(F.col("pid"))
    got = {r["pid"]: (r["f"], r["back"]) for r in rows.select("pid", field.alias("f"), indexing.pid_of_field(field).alias("back")).collect()}
    assert got["abc"] == (b"abc".ljust(64, b"\0"), "abc") and got["é" * 40][1] == "é" * 32
    assert got[""] == (b"\0" * 64, "") and got[None] == (None, None)
    names = spark.createDataFrame([("block_2.pb",), ("block_10.pb",), ("readme",)], "value string")
    assert indexing.largest_block(names).first()["block"] == 10
    assert indexing.largest_block(names.filter("value = 'readme'")).first()["block"] is None


def test_flat_map(spark):
    rows = spark.range(10).select(F.col("id").alias("row_no"), (F.col("id") % 3).alias("n"))
    got = indexing.flat_map(rows, lambda row, i: ({"i": i, "j": j} for j in range(row["n"])), "i long, j long")
    assert sorted(map(tuple, got.collect())) == [(i, j) for i in range(10) for j in range(i % 3)]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 17, 400])
def test_ranges_of_two_steps(spark, n):
    edges = [float(3 * i) for i in range(n)]
    rows = spark.range(-2, 3 * n + 3).select("id", indexing._range_of(F.col("id").cast("double"), edges).alias("r"))
    assert all(r["r"] == sum(e < r["id"] for e in edges) for r in rows.collect())


def test_streams_of_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wt") as out:
        out.write("one\ntwo\n")
    (tmp_path / "b.txt").write_text("three\n")
    lines = readers.split_lines(spark, [str(tmp_path / "a.gz"), str(tmp_path / "b.txt")])
    assert [r["value"] for r in lines.orderBy("split", "line_no").collect()] == ["one", "two", "three"]
    expected = spark.createDataFrame([("b.txt", "F" * 64), ("c.txt", "00")], "name string, sha256 string")
    found = readers.digests(spark, str(tmp_path / "b.txt"))
    assert {tuple(r) for r in readers.wrong_digests(found, expected).collect()} == {("b.txt", "differs"), ("c.txt", "missing")}
    assert readers.wrong_digests(found, found.select(F.lit("b.txt").alias("name"), F.upper("sha256").alias("sha256"))).count() == 0


def test_settings_that_are_needed(tmp_path):
    (tmp_path / "c.toml").write_text('qrels = "q"\n')
    with pytest.raises(ValueError, match="collection"):
        config.load(str(tmp_path / "c.toml"), needed=("qrels", "collection"))


def test_stored_index_finds_the_same(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("pid"), "text")
    odd = spark.createDataFrame([("none", None), ("empty", ""), ("signs", "!?")], "pid string, text string")
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))
    lexical.write_index(docs.unionAll(odd), str(tmp_path / "index"), 8)
    rows = lambda x: sorted(map(tuple, x.select("qid", "pid", "score", "rank").collect()))
    assert rows(lexical.search_index(spark, str(tmp_path / "index"), questions, 20)) == rows(lexical.search(docs.unionAll(odd), questions, 20))


def test_commands_from_passages_to_runs(spark, tmp_path, capsys):
    run = lambda *argv: cli.main([str(x) for x in argv], spark)
    (tmp_path / "p.jsonl").write_text("".join(json.dumps({"id": f"p{i}", "contents": f"cats {'dogs ' * i}"}) + "\n" for i in range(5)))
    (tmp_path / "qrels.txt").write_text("1_1 0 p0 1\n1_2 0 p1 1\n")
    (tmp_path / "q.jsonl").write_text("".join(json.dumps({"sample_id": f"1-{i}", "rewrite_utt_text": "cats? dogs?", "response_utt_text": "dogs"}) + "\n" for i in (1, 2, 3)))
    run("embed", "--input", tmp_path / "p.jsonl", "--output", tmp_path / "vectors")
    run("dense", "--input", tmp_path / "q.jsonl", "--collection", tmp_path / "vectors", "--encoder", "larkspur.operators.dense:hash_encoder", "--split-rewrite", "--qrels", tmp_path / "qrels.txt", "--output", tmp_path / "run", "--top-k", 2)
    lines = [r["value"].split() for r in spark.read.text(str(tmp_path / "run")).collect()]
    assert {x[0] for x in lines} == {"1-1", "1-2"} and len(lines) == 4
    run("index", "--collection", tmp_path / "p.jsonl", "--output", tmp_path / "index")
    for name, where in (("index", "index"), ("collection", "p.jsonl")):
        run("bm25", "--input", tmp_path / "q.jsonl", "--qrels", tmp_path / "qrels.txt", f"--{name}", tmp_path / where, "--output", tmp_path / f"run_{name}")
    same = [sorted(r["value"] for r in spark.read.text(str(tmp_path / f"run_{n}")).collect()) for n in ("index", "collection")]
    assert same[0] == same[1] and len(same[0]) == 10
    run("tokens", "--input", tmp_path / "p.jsonl", "--output", tmp_path / "records", "--max-seq-length", 4)
    run("verify", "--input", tmp_path / "records", "--max-seq-length", 4, "--embeddings", tmp_path / "vectors", "--width", 64)
    assert "no faults" in capsys.readouterr().out
    with pytest.raises(SystemExit, match="width: 5; vectors: 5"):
        run("verify", "--input", tmp_path / "records", "--max-seq-length", 5, "--embeddings", tmp_path / "vectors", "--width", 3)


def test_tokenizer_file(spark):
    public = pytest.importorskip("public_tokenizers", reason="the tokenizers' folder is not there")
    rows = spark.createDataFrame([("a b c d",), (None,)], "text string")
    ids = rows.select(indexing.token_ids(F.col("text"), indexing.file_tokenizer(public.path("byte_bpe_50k.json"), 2)).alias("ids")).collect()
    assert [len(r["ids"]) for r in ids] == [2, 0]


def test_postings_with_and_without_terms_are_alike_and_tokenise_once(spark):
    docs = spark.createDataFrame([("a", "One two, one"), ("b", ""), ("c", None), ("d", "... !"), ("e", "Two")], "pid string, text string")
    every = lexical.postings(docs)
    some = lexical.postings(docs, every.select("term").distinct())
    told = [("a", 3, "one", 2), ("a", 3, "two", 1), ("e", 1, "two", 1)]
    for found in (every, some):
        assert sorted((r["pid"], r["dl"], r["term"], r["tf"]) for r in found.collect()) == told
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
