"""python -m larkspur.cli COMMAND: the operators over files."""

from __future__ import annotations

import argparse
import importlib
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import config, schemas
from larkspur.functions import outputs, prompts
from larkspur.operators import dense, dialogue, evaluation, indexing, lexical, ports
from larkspur.sources import readers, writers

SUBSETS = ("full", "subset", "corrected")


def _turns(spark: SparkSession, path: str) -> DataFrame:
    return readers.turns(spark, path).withColumn("pos", F.col("line_no"))


def _ids(spark: SparkSession, path: str) -> DataFrame:
    return readers.assessed_ids(readers.numbered_lines(spark, path))


def flatten(spark, a):
    rows = dialogue.flatten(readers.topics(spark, a.input), a.only_needs_ptkb)
    writers.overwrite_json(rows.repartitionByRange("number").sortWithinPartitions("number", "pos").drop("pos"), a.output)


def prompt_rows(turns: DataFrame, kind: str, prompt_type: int = 1, annotation: DataFrame | None = None, demo: str | None = None) -> DataFrame:
    """custom_id, prompt of assessed turns, by kind: select, reformulate (with provenance from `annotation`), sar, automatic."""
    past = prompts.history(F.col("ctx_utts_text"), F.col("history_response"))
    rows = turns.withColumn("past", past).withColumn("facts", dialogue.facts(F.col("ptkb")))
    question = F.col("cur_utt_text")
    if kind == "automatic":
        rows = dialogue.explode_facts(rows)
        prompt = prompts.automatic(F.col("fact"), F.col("past"), question)
    elif kind == "select":
        prompt = prompts.select(F.col("facts"), F.col("past"), question, demo, batch=True)
    elif kind == "sar":
        prompt = prompts.select_and_reformulate(F.col("facts"), F.col("past"), question, demo)
    else:
        rows = dialogue.join_provenance(rows, annotation)
        prompt = prompts.reformulate(prompt_type, prompts.label(dialogue.lookup(F.col("provenance"), F.col("ptkb"))), F.col("past"), question)
    return rows.select(F.col("sample_id").alias("custom_id"), prompt.alias("prompt"))


def requests(spark, a):
    turns = dialogue.assessed(_turns(spark, a.input), _ids(spark, a.qrels))
    if a.done:
        turns = dialogue.unprocessed(turns, readers.turns(spark, a.done))
    source = readers.turns(spark, a.selections) if a.annotation in ("LLM", "STR") else turns
    known = dialogue.provenance(source, a.annotation) if a.kind == "reformulate" else None
    demo = None
    if a.shot:
        train = readers.topics(spark, a.train).withColumn("line_no", F.monotonically_increasing_id())
        numbers = [r["number"] for r in dialogue.random_numbers(train, a.shot, a.seed).collect()] if a.random_examples else dialogue.SHOTS[a.shot]
        demo = "".join(r["text"] for r in dialogue.few_shot(train, numbers).orderBy("position").collect())
    system = prompts.SYSTEM_SELECT if a.kind == "select" else prompts.SYSTEM_ONLINE if a.kind == "sar" else prompts.SYSTEM_BATCH
    writers.overwrite_json(ports.batch_requests(prompt_rows(turns, a.kind, a.prompt_type, known, demo), a.model, system), a.output)


def collect(spark, a):
    answers = readers.batch_responses(readers.numbered_lines(spark, a.input)).withColumnRenamed("custom_id", "sample_id")
    text = F.col("content")
    if a.kind == "select":
        rows = answers.select("sample_id", outputs.parse_selection(text, batch=True).alias("LLM_select")).filter("LLM_select is not null")
    else:
        parsed = {"sar": outputs.parse_sar_batch, "automatic": lambda t: outputs.parse_automatic(t, batch=True), "reformulate": outputs.parse_prompt1 if a.prompt_type == 1 else outputs.parse_prompt2}[a.kind](text)
        rows = answers.withColumn("p", parsed).filter("p is not null")
        more = [F.col("p.provenance").alias("LLM_select")] if a.kind == "sar" else []
        rows = rows.select("sample_id", *more, F.col("p.rewrite").alias("rewrite_utt_text"), F.col("p.response").alias("response_utt_text"))
    writers.write_once(rows, a.output)


def bm25(spark, a):
    turns = dialogue.relevant(readers.turns(spark, a.input).withColumnRenamed("sample_id", "qid"), _ids(spark, a.qrels)).withColumnRenamed("qid", "sample_id")
    queries = lexical.build_queries(turns, a.query_type, a.query_number, a.c)
    if a.index:
        run = lexical.search_index(spark, a.index, queries, a.top_k, a.bm25_k1, a.bm25_b)
    else:
        run = lexical.search(_passages(spark, a.collection), queries, a.top_k, a.bm25_k1, a.bm25_b)
    writers.write_run(run, a.output or _run_path(spark, a, "bm25_", query_type=a.query_type), "bm25", seven=True)


def _passages(spark: SparkSession, path: str) -> DataFrame:
    return readers.passages_json(spark.read.text(path)).select(F.col("id").alias("pid"), F.col("contents").alias("text"))


def _run_path(spark: SparkSession, a, kind: str, **options) -> str:
    return spark.range(1).select(writers.run_path(a.input, kind, tag=a.output_id, **options)).first()[0]


def _named(name: str) -> Callable:
    """The object that module:name says."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def index(spark, a):
    """Writes a BM25 index of a passage collection."""
    lexical.write_index(_passages(spark, a.collection), a.output)


def embed(spark, a):
    """Vectors of a passage collection, as Parquet (pid, vector)."""
    rows = dense.encode(_passages(spark, a.input), "text", _named(a.encoder))
    writers.write_collection(rows.select("pid", "vector"), a.output, a.rows_per_block)


def dense_search(spark, a):
    """Collection as Parquet (pid, vector). Queries as Parquet (qid, vector), or, with an encoder, rewrite records."""
    if a.encoder:
        texts = dense.query_texts(readers.turns(spark, a.input), a.split_rewrite)
        vectors = dense.encode(texts, "text", _named(a.encoder)).select("qid", "vector")
    else:
        vectors = spark.read.parquet(a.input)
    if a.qrels:
        vectors = dialogue.relevant(vectors, _ids(spark, a.qrels))
    hits = dense.topk(spark.read.parquet(a.collection), dense.mean_vectors(vectors, "qid"), a.top_k)
    writers.write_run(dense.dedupe(hits, a.top_k), a.output or _run_path(spark, a, "ance_", split=a.split_rewrite), "dense")


def tokens(spark, a):
    """Numbered, sharded, fixed-width token rows of a passage collection (without a tokenizer's file: a hash of each word)."""
    from larkspur.functions.text import tokenize

    if a.tokenizer:
        ids = indexing.token_ids(F.col("contents"), indexing.file_tokenizer(a.tokenizer, a.max_seq_length))
    else:
        ids = F.transform(tokenize(F.col("contents")), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(1 << 30)).cast("int"))
    rows = readers.passages_json(spark.read.text(a.input), a.max_doc_character).select(F.col("id").alias("pid"), "contents")
    numbered = indexing.row_index(rows.withColumn("_at", F.xxhash64("pid").cast("double")), "_at", "pid")
    records = indexing.token_records(indexing.offsets(numbered, a.shards).withColumn("ids", ids), a.max_seq_length)
    writers.write_collection(records, a.output)


def verify(spark, a):
    """Settings, token rows and, if given, vectors: exits with what is wrong with them."""
    if a.settings:
        config.load(a.settings, needed=a.needed)
    faults = indexing.collection_faults(spark.read.parquet(a.input), a.max_seq_length)
    if a.embeddings:
        vectors = spark.read.parquet(a.embeddings)
        if wrong := indexing.wrong_vectors(vectors, a.width or len(vectors.first()["vector"])).count():
            faults["vectors"] = wrong
    if faults:
        raise SystemExit("; ".join(f"{what}: {n}" for what, n in faults.items()))
    print("no faults")


def _client(a) -> ports.BatchClient:
    if a.service:
        return ports.HttpBatches(a.service, os.environ.get(a.key_variable, ""))
    return ports.FolderBatches(a.folder)


def _registry(a) -> ports.BatchRegistry:
    return ports.BatchRegistry(str(Path(a.folder) / "batch_ids.json"))


def submit(spark, a):
    """Sends a written folder of requests, as one file of its name, to the service (or the folder that stands for it)."""
    Path(a.folder).mkdir(parents=True, exist_ok=True)
    path = Path(a.folder) / f"{Path(a.input).name}.jsonl"
    with path.open("wb") as out:
        for part in sorted(Path(a.input).glob("part-*")) if Path(a.input).is_dir() else [Path(a.input)]:
            out.write(part.read_bytes())
    print(ports.submit_batch(str(path), _client(a), _registry(a), a.description))


def status(spark, a):
    """The state of every batch whose name holds the pattern; what is finished and new is fetched into processed/."""
    client, processed = _client(a), Path(a.folder) / "processed"
    processed.mkdir(parents=True, exist_ok=True)
    known = {name: batch_id for name, batch_id in _registry(a).read().items() if a.pattern in name}
    for name, batch_id in known.items():
        print(name, client.status(batch_id))
    ports.collect_batches(known, client, str(processed), a.pattern, exists=lambda path: Path(path).exists())


def cancel(spark, a):
    known = {name: batch_id for name, batch_id in _registry(a).read().items() if a.pattern in name}
    ports.cancel_batches(known, _client(a))


def run_metrics(spark, run_path: str, a) -> DataFrame:
    """subset and the reported metrics of one run; with facts in its ids also both variants of the best fact."""
    qrels = readers.qrels(readers.numbered_lines(spark, a.qrels), a.rel_threshold)
    run, ids, turns = readers.run(readers.numbered_lines(spark, run_path)), _ids(spark, a.qrels), _turns(spark, a.turns)
    if a.automatic:
        split = evaluation.split_automatic(run)
        metrics = evaluation.per_query(split, qrels, ("qid", "ptkb"))
        kinds = {"_baseline": False, "_always_ptkb": True}
        parts = [(s + v, evaluation.best_fact(evaluation.on_subset(metrics, dialogue.subset(turns, ids, s)), evaluation.first_seen(split), k)) for s in SUBSETS for v, k in kinds.items()]
    else:
        metrics = evaluation.per_query(run, qrels)
        parts = [(s, evaluation.on_subset(metrics, dialogue.subset(turns, ids, s))) for s in SUBSETS]
    out = None
    for name, part in parts:
        row = evaluation.summary(part).withColumn("subset", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def evaluate(spark, a):
    run_metrics(spark, a.input, a).select("subset", *[F.col(f"`{m}`") for m in schemas.METRICS]).show(truncate=False)


def aggregate(spark, a):
    """Long statistics (name, subset, metric, min ... median) over runs, all of which have to be there."""
    values = None
    for i, path in enumerate(a.runs, 1):
        rows = evaluation.long_metrics(run_metrics(spark, path, a).withColumn("run", F.lit(i)), "subset", "run")
        values = rows if values is None else values.unionByName(rows)
    writers.write_once(evaluation.run_statistics(values, "subset", "metric").withColumn("name", F.lit(a.name)), a.output)


def significance(spark, a):
    if len(a.files) < 2:
        raise SystemExit("at least two files are needed")
    stats = None
    for i, path in enumerate(a.files):
        rows = spark.read.schema("name string, subset string, metric string, mean double, std double").json(path).withColumn("position", F.lit(i))
        stats = rows if stats is None else stats.unionByName(rows)
    evaluation.significant(evaluation.t_tests(stats, a.number, tuple(a.metrics)), a.confidence).orderBy("subset", "name1", "name2", "metric").show(1000, truncate=False)


def stats(spark, a):
    passages = readers.passages_json(spark.read.text(a.collection))
    dialogue.dataset_stats(readers.topics(spark, a.input), _ids(spark, a.qrels), passages).show(truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="larkspur", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *options: tuple) -> None:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flag, kwargs in options:
            p.add_argument(flag, **kwargs)

    need, flag = {"required": True}, {"action": "store_true"}
    given, out, judged = ("--input", need), ("--output", need), ("--qrels", need)
    kind = ("--kind", {"choices": ["select", "reformulate", "sar", "automatic"], **need})
    prompt = ("--prompt-type", {"type": int, "choices": [1, 2], "default": 1})
    where = (("--output", {}), ("--output-id", {}))
    encoder = "--encoder"
    service = (("--folder", need), ("--service", {}), ("--key-variable", {"default": "BATCH_API_KEY"}), ("--pattern", {"default": ""}))
    k = ("--top-k", {"type": int, "default": 1000})
    measure = (judged, ("--turns", need), ("--rel-threshold", {"type": int, "default": 1}), ("--automatic", flag))
    command("flatten", flatten, given, out, ("--only-needs-ptkb", flag))
    command("requests", requests, given, out, judged, kind, prompt, ("--done", {}), ("--annotation", {"choices": ["LLM", "STR", "human", "None", "All"], "default": "human"}), ("--selections", {}), ("--shot", {"type": int, "choices": [0, 1, 3, 5], "default": 0}), ("--train", {}), ("--random-examples", flag), ("--seed", {"type": int, "default": 42}), ("--model", {"default": "gpt-4o-mini"}))
    command("collect", collect, given, out, kind, prompt)
    command("bm25", bm25, given, *where, judged, ("--collection", {}), ("--index", {}), k, ("--query-type", {"default": "concat"}), ("--query-number", {"type": int, "default": 1}), ("--c", {"type": float, "default": 1.0}), ("--bm25-k1", {"type": float, "default": lexical.K1}), ("--bm25-b", {"type": float, "default": lexical.B}))
    command("index", index, ("--collection", need), out)
    command("embed", embed, given, out, (encoder, {"default": "larkspur.operators.dense:hash_encoder"}), ("--rows-per-block", {"type": int, "default": 2_500_000}))
    command("dense", dense_search, given, *where, ("--qrels", {}), ("--collection", need), (encoder, {}), ("--split-rewrite", flag), k)
    command("verify", verify, given, ("--max-seq-length", {"type": int, "default": 384}), ("--embeddings", {}), ("--width", {"type": int}), ("--settings", {}), ("--needed", {"nargs": "+", "default": ["collection", "output"]}))
    command("submit", submit, given, ("--description", {"default": ""}), *service)
    command("status", status, *service)
    command("cancel", cancel, *service)
    command("tokens", tokens, given, out, ("--tokenizer", {}), ("--max-doc-character", {"type": int, "default": 10_000}), ("--max-seq-length", {"type": int, "default": 384}), ("--shards", {"type": int, "default": 32}))
    command("evaluate", evaluate, given, *measure)
    command("aggregate", aggregate, ("--runs", {"nargs": "+", **need}), ("--name", need), out, *measure)
    command("significance", significance, ("--files", {"nargs": "+", **need}), ("--number", {"type": int, "default": 5}), ("--confidence", {"type": float, "default": 0.05}), ("--metrics", {"nargs": "+", "default": ["MRR", "NDCG@3", "NDCG@5", "MAP"]}))
    command("stats", stats, given, judged, ("--collection", need))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
