"""Conversations, their turns and personal facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import base_id, extract_numbers, sample_id


def flatten(topics: DataFrame, only_facts: bool = False) -> DataFrame:
    """One row a turn with all earlier utterances and responses of its conversation (in file order).

    A turn with id 1 starts the context anew. With `only_facts` turns without provenance go after contexts are known.
    """
    rows = topics.select("number", "title", "ptkb", F.posexplode("turns").alias("pos", "t"))
    rows = rows.withColumn("_start", F.sum((F.col("t.turn_id") == 1).cast("int")).over(Window.partitionBy("number").orderBy("pos")))
    before = Window.partitionBy("number", "_start").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.collect_list("t.utterance").over(before).alias("ctx_utts_text"), F.collect_list("t.response").over(before).alias("history_response"))
    if only_facts:
        rows = rows.filter(F.size(F.coalesce("t.ptkb_provenance", F.array())) > 0)
    return rows.select(
        sample_id(F.col("number"), F.col("t.turn_id")).alias("sample_id"), "number", "pos", "title",
        F.col("t.utterance").alias("cur_utt_text"), F.col("t.resolved_utterance").alias("oracle_utt_text"), F.col("t.response").alias("cur_response_text"),
        "ptkb", F.col("t.ptkb_provenance").alias("ptkb_provenance"), F.col("t.response_provenance").alias("response_provenance"), "ctx_utts_text", "history_response",
    )


def facts(ptkb: Column) -> Column:
    """A fact map as an array of (idx, fact); equal maps give equal arrays, in the map's own order."""
    return F.transform(F.map_entries(ptkb), lambda e: F.struct(e["key"].alias("idx"), e["value"].alias("fact")))


def lookup(provenance: Column, ptkb: Column) -> Column:
    """Facts for provenance items, in order; repeated ones repeat, missing or empty ones go."""
    found = F.transform(provenance, lambda i: F.try_element_at(ptkb, i.cast("string")))
    return F.filter(found, lambda f: f.isNotNull() & (f != ""))


def explode_facts(turns: DataFrame) -> DataFrame:
    """One row for each fact of a turn; the id gets the fact's number."""
    return turns.select("*", F.explode("ptkb").alias("ptkb_num", "fact")).withColumn("sample_id", F.concat_ws("-", "sample_id", "ptkb_num"))


def provenance(turns: DataFrame, annotation: str) -> DataFrame:
    """sample_id, provenance (texts): what an annotation source says which facts a turn needs; the last row of an id counts."""
    chosen = {
        "LLM": extract_numbers(F.col("LLM_select")), "STR": extract_numbers(F.col("LLM_select")), "None": F.array().cast("array<string>"),
        "All": F.map_keys("ptkb"), "human": F.col("ptkb_provenance").cast("array<string>"),
    }
    if annotation not in chosen:
        raise ValueError(f"annotation {annotation}")
    rows = turns.select("sample_id", "line_no", chosen[annotation].alias("provenance"))
    return rows.groupBy("sample_id").agg(F.max_by("provenance", "line_no").alias("provenance"))


def join_provenance(turns: DataFrame, known: DataFrame) -> DataFrame:
    return turns.join(known, "sample_id", "left").withColumn("provenance", F.coalesce("provenance", F.array().cast("array<string>")))


def assessed(turns: DataFrame, ids: DataFrame) -> DataFrame:
    return turns.join(ids.select(F.col("qid").alias("sample_id")), "sample_id", "left_semi")


def unprocessed(turns: DataFrame, done: DataFrame) -> DataFrame:
    """Turns whose id is not among those already written; empty ids do not count."""
    return turns.join(done.filter(F.coalesce("sample_id", F.lit("")) != "").select("sample_id"), "sample_id", "left_anti")


def relevant(queries: DataFrame, ids: DataFrame) -> DataFrame:
    """Queries whose qid, or qid without its last segment, is among the ids: two equality joins, no disjunction."""
    ids = ids.select("qid").distinct()
    own = queries.join(ids, "qid", "left_semi")
    rest = queries.join(ids, "qid", "left_anti").withColumn("_base", base_id(F.col("qid")))
    return own.unionByName(rest.join(ids.withColumnRenamed("qid", "_base"), "_base", "left_semi").drop("_base"))


def corrected_subset(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """sample_id of the turns that use a fact for the first time (number, pos, sample_id, ptkb_provenance; ids: qid).

    In file order within a conversation, a turn that shares an item with what was seen is skipped and adds nothing; others
    add theirs, and count if they are assessed and have any. One conversation is folded inside one row.
    """
    marked = turns.select("number", "pos", "sample_id", F.coalesce("ptkb_provenance", F.array().cast("array<int>")).alias("prov")).join(ids.select(F.col("qid").alias("sample_id"), F.lit(True).alias("judged")).distinct(), "sample_id", "left")
    rows = marked.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("pos", "sample_id", "prov", F.coalesce("judged", F.lit(False)).alias("judged")))).alias("rows"))
    start = F.struct(F.array().cast("array<int>").alias("seen"), F.array().cast("array<string>").alias("keep"))

    def step(acc, t):
        counts = t["judged"] & (F.size(t["prov"]) > 0)
        added = F.struct(F.array_union(acc["seen"], t["prov"]).alias("seen"), F.when(counts, F.array_append(acc["keep"], t["sample_id"])).otherwise(acc["keep"]).alias("keep"))
        return F.when(F.coalesce(F.arrays_overlap(acc["seen"], t["prov"]), F.lit(False)), acc).otherwise(added)

    return rows.select(F.explode(F.aggregate("rows", start, step, lambda acc: acc["keep"])).alias("sample_id"))


def subset(turns: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """qid of the evaluated set: 'full' (all assessed), 'subset' (assessed turns with provenance) or 'corrected'."""
    if kind == "full":
        return ids.select("qid").distinct()
    if kind == "subset":
        return assessed(turns, ids).filter(F.size(F.coalesce("ptkb_provenance", F.array().cast("array<int>"))) > 0).select(F.col("sample_id").alias("qid"))
    if kind == "corrected":
        return corrected_subset(turns, ids).withColumnRenamed("sample_id", "qid")
    raise ValueError(f"subset {kind}")


def few_shot(topics: DataFrame, numbers: list[str]) -> DataFrame:
    """position, text: an example block for each chosen conversation, numbered in file order (line_no)."""
    from larkspur.functions.prompts import facts_repr

    chosen = topics.filter(F.col("number").isin(numbers))
    show = lambda items: F.concat(F.lit("["), F.array_join(items.cast("array<string>"), ", "), F.lit("]"))
    turn = lambda t: F.concat(F.lit("Question: "), t["utterance"], F.lit("\nprovenance: "), show(t["ptkb_provenance"]), F.lit("\nRewrite: "), t["resolved_utterance"], F.lit("\nResponse: "), t["response"], F.lit("\n\n"))
    ranked = chosen.withColumn("position", F.row_number().over(Window.orderBy("line_no")))  # a handful of examples
    body = F.concat(F.lit("# Example "), F.col("position").cast("string"), F.lit("\n\nUser's information: "), facts_repr(facts(F.col("ptkb"))), F.lit("\n\n"), F.array_join(F.transform("turns", turn), ""))
    return ranked.select("position", body.alias("text"))


#: Conversations shown for each number of examples; fixed values.
SHOTS = {1: ["1-1"], 3: ["1-1", "1-2", "2-1"], 5: ["1-1", "1-2", "2-1", "2-2", "7-1"]}


def random_numbers(topics: DataFrame, shots: int, seed: int) -> DataFrame:
    """A repeatable sample of conversations without replacement: those of the smallest digests of number and seed."""
    return topics.select("number").distinct().orderBy(F.md5(F.concat("number", F.lit(f":{seed}")).cast("binary")), "number").limit(shots)


def dataset_stats(topics: DataFrame, ids: DataFrame, collection: DataFrame) -> DataFrame:
    """variable, value: titles, conversations, turns, turns with facts, assessed ids, passages."""
    has = lambda t: F.size(F.coalesce(t["ptkb_provenance"], F.array().cast("array<int>"))) > 0
    t = topics.agg(F.count_distinct("title").alias("topics"), F.count(F.lit(1)).alias("conversations"), F.sum(F.size("turns")).alias("turns"), F.sum(F.size(F.filter("turns", has))).alias("total_ptkb_turns"))
    rows = t.unpivot([], ["topics", "conversations", "turns", "total_ptkb_turns"], "variable", "value")
    rows = rows.unionByName(ids.agg(F.count_distinct("qid").alias("value")).select(F.lit("assessed_turns").alias("variable"), "value"))
    return rows.unionByName(collection.agg(F.count(F.lit(1)).alias("value")).select(F.lit("collection").alias("variable"), "value"))
