"""The commands over small files, one after the other."""

import json

import pytest

from larkspur import cli, config


@pytest.fixture
def folder(tmp_path):
    turn = lambda i, prov: {"turn_id": i, "utterance": f"what about cats {i}?", "resolved_utterance": f"what about cats {i} here?", "response": f"cats and dogs {i}", "ptkb_provenance": prov, "response_provenance": []}
    topics = [{"number": n, "title": "pets", "ptkb": {"1": "I have a cat.", "2": "I'm 26."}, "turns": [turn(1, [1]), turn(2, [1, 2]), turn(3, [2]), turn(4, [])]} for n in ("1-1", "2-1")]
    (tmp_path / "topics.json").write_text(json.dumps(topics))
    (tmp_path / "qrels.txt").write_text("".join(f"{n}_{i} 0 p{j} {(i + j) % 3}\n" for n in ("1-1", "2-1") for i in (1, 2, 3, 4) for j in range(4)))
    (tmp_path / "passages.jsonl").write_text("".join(json.dumps({"id": f"p{j}", "contents": f"cats {'dogs ' * j} number {j}"}) + "\n" for j in range(6)))
    return tmp_path


def lines(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_from_topics_to_significance(spark, folder, capsys):
    run = lambda *argv: cli.main([str(x) for x in argv], spark)
    flat, qrels = folder / "flat", folder / "qrels.txt"
    run("flatten", "--input", folder / "topics.json", "--output", flat)
    assert len(lines(flat)) == 8
    for kind, count in (("select", 8), ("reformulate", 8), ("sar", 8), ("automatic", 16)):
        run("requests", "--kind", kind, "--input", flat, "--qrels", qrels, "--output", folder / f"ask_{kind}", "--shot", 1 if kind in ("select", "sar") else 0, "--train", folder / "topics.json")
        asked = lines(folder / f"ask_{kind}")
        assert len(asked) == count and all(r["body"]["messages"][1]["content"] for r in asked)
        if kind == "select":
            assert "# Example 1\n\nUser's information: {'1': 'I have a cat.', '2': \"I'm 26.\"}" in asked[0]["body"]["messages"][1]["content"]
    said = {"select": "Provenance: 1", "reformulate": "Response: cats Queries: cats dogs", "sar": "Provenance: 1\nRewrite: cats dogs\nResponse: cats", "automatic": "Rewrite: cats\nResponse: dogs"}
    for kind, answer in said.items():
        body = {"body": {"choices": [{"message": {"content": answer}}]}}
        (folder / f"said_{kind}").write_text("".join(json.dumps({"custom_id": r["custom_id"], "response": body}) + "\n" for r in lines(folder / f"ask_{kind}")))
        run("collect", "--kind", kind, "--input", folder / f"said_{kind}", "--output", folder / f"got_{kind}")
        assert len(lines(folder / f"got_{kind}")) == (16 if kind == "automatic" else 8)
    run("requests", "--kind", "reformulate", "--annotation", "LLM", "--selections", folder / "got_select", "--prompt-type", 2, "--done", folder / "got_sar", "--input", flat, "--qrels", qrels, "--output", folder / "nothing")
    assert lines(folder / "nothing") == []
    for kind in ("sar", "automatic"):
        run("bm25", "--input", folder / f"got_{kind}", "--qrels", qrels, "--collection", folder / "passages.jsonl", "--output", folder / f"run_{kind}", "--top-k", 5)
    measure = ["--qrels", qrels, "--turns", flat]
    run("evaluate", "--input", folder / "run_sar", *measure)
    shown = capsys.readouterr().out
    assert all(f"|{s}" in shown for s in ("full", "subset", "corrected"))
    run("evaluate", "--input", folder / "run_automatic", *measure, "--automatic")
    assert "corrected_always_ptkb" in capsys.readouterr().out
    for name in ("a", "b"):
        run("aggregate", "--name", name, "--runs", folder / "run_sar", folder / "run_sar", "--output", folder / f"stats_{name}", *measure)
    stats = lines(folder / "stats_a")
    assert len(stats) == 24 and all(r["std"] == 0 and r["min"] == r["max"] for r in stats)
    run("significance", "--files", folder / "stats_a", folder / "stats_b", "--number", 2)
    run("stats", "--input", folder / "topics.json", "--qrels", qrels, "--collection", folder / "passages.jsonl")
    assert "total_ptkb_turns|6" in capsys.readouterr().out.replace(" ", "")
    run("tokens", "--input", folder / "passages.jsonl", "--output", folder / "records", "--max-seq-length", 4)
    assert sorted(r["offset"] for r in spark.read.parquet(str(folder / "records")).collect()) == list(range(6))


def test_dense_command(spark, tmp_path):
    spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "pid string, vector array<double>").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("q", [1.0, 0.0]), ("q", [1.0, 0.2])], "qid string, vector array<double>").write.parquet(str(tmp_path / "q"))
    cli.main(["dense", "--input", str(tmp_path / "q"), "--collection", str(tmp_path / "p"), "--output", str(tmp_path / "run")], spark)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "run")).collect()) == ["q Q0 a 1 1.0 dense", "q Q0 b 2 0.1 dense"]


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('qrels = "data/{YEAR}.txt"\ntop_k = 7\n')
    s = config.load(str(tmp_path / "c.toml"), "2024")
    assert (s.qrels, s.top_k, s.shards) == ("data/2024.txt", 7, 32)
    (tmp_path / "d.toml").write_text("nonsense = 1\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "d.toml"))
