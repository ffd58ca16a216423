"""Inputs for the registered queries, made from the given tables by formulas that their SQL repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import evaluation
from larkspur.sources import readers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a turn: number, turn, turn_id, title, utterance, response (the next turn's text), prov."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    prov = F.when(F.col("turn") % 4 == 3, F.array().cast("array<int>")).otherwise(F.array(((F.col("conv_id") + F.col("turn")) % 7).cast("int"), ((3 * F.col("conv_id") + F.col("turn") * F.col("turn")) % 7).cast("int")))
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select(
        "conv_id", F.col("conv_id").cast("string").alias("number"), "turn", (F.col("turn") + 1).cast("int").alias("turn_id"), F.concat(F.lit("topic "), (F.col("conv_id") % 10).cast("string")).alias("title"),
        F.col("text").alias("utterance"), F.concat("text", F.lit(" (resolved)")).alias("resolved_utterance"), F.coalesce(following, F.lit("")).alias("response"), prov.alias("ptkb_provenance"),
    )


def fact_map(number) -> F.Column:
    fact = lambda i: F.lit("") if i == 3 else F.concat(F.lit("it's fact 2 of " if i == 2 else f"fact {i} of "), number)
    return F.create_map(*[x for i in range(5) for x in (F.lit(str(i)), fact(i))])


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_rows(spark, sf_dir)
    turn = F.struct("turn_id", "utterance", "resolved_utterance", "response", "ptkb_provenance", F.array().cast("array<string>").alias("response_provenance"))
    nested = rows.groupBy("number", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]).alias("turns"))
    return nested.select("number", "title", fact_map(F.col("number")).alias("ptkb"), "turns", F.col("number").cast("long").alias("line_no"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.operators.dialogue import flatten

    flat = flatten(topics(spark, sf_dir))
    return flat.withColumn("line_no", F.col("number").cast("long") * 1000 + F.col("pos"))


def assessed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter((F.col("conv_id") + F.col("turn")) % 3 != 0)
    value = F.concat(F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") + 1).cast("string"), F.lit(" 0  doc "), (F.col("turn") % 4).cast("string"))
    short = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.lit("only three fields").alias("value"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), value.alias("value")).unionByName(short)


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.sources.readers import assessed_ids

    return assessed_ids(assessed_lines(spark, sf_dir))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, line_no, answer: what a model might have said, some of it malformed."""
    t = conversation_rows(spark, sf_dir)
    u, r = F.col("utterance"), F.col("response")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    answer = (
        F.when(F.col("turn") % 5 == 0, say("Response: ", r, "\n Queries:  ", u))
        .when(F.col("turn") % 5 == 1, say("Rewrite: ", u, "\nResponse: ", r))
        .when(F.col("turn") % 5 == 2, say("Provenance: 1, 2\nRewrite: ", u, "\nResponse: ", r, " "))
        .when(F.col("turn") % 5 == 3, say("Provenance: 3 Rewrite: ", u, " Response: ", r))
        .otherwise(say("None of it: ", u))
    )
    return t.select(F.concat_ws("-", "number", F.col("turn_id").cast("string")).alias("sample_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), answer.alias("answer"))


def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rewrite records: rewrite (some of them lists or questions), response."""
    t = turns(spark, sf_dir)
    u = F.col("cur_utt_text")
    rewrite = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("1. "), u, F.lit('?\n2. "'), u, F.lit('"? more'))).when(F.col("pos") % 3 == 1, F.concat(u, F.lit(", a, b, a,, c, d, e, f"))).otherwise(u)
    return t.withColumn("rewrite_utt_text", rewrite).withColumn("response_utt_text", F.col("cur_response_text")).withColumn("fusion", F.concat_ws(" | ", "cur_utt_text", "sample_id"))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with LLM_select in the forms that occur."""
    a, b = F.get("ptkb_provenance", F.lit(0)).cast("string"), F.get("ptkb_provenance", F.lit(1)).cast("string")
    chosen = F.when(F.size("ptkb_provenance") == 0, F.lit("None")).when(F.col("pos") % 3 == 0, F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]"))).when(F.col("pos") % 3 == 1, F.concat(a, F.lit(", "), b)).otherwise(F.concat(F.lit("$"), a, F.lit(", $"), b))
    return turns(spark, sf_dir).withColumn("LLM_select", chosen)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pid"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def judgement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded judgements (-1 to 2) of every tenth document for each question; some are said twice, the last counts."""
    d, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "benchmark").select("item_id")
    pairs = d.withColumn("m", F.col("doc_id") % 10).join(b.withColumn("m", F.col("item_id") % 10), "m")
    grade = (F.floor(F.col("doc_id") / 10) * 7 + F.col("item_id") * 3) % 4 - 1
    line = lambda shift, rel: pairs.select((F.col("item_id") * 10_000_000 + F.col("doc_id") * 2 + shift).alias("line_no"), F.concat_ws(" ", F.col("item_id").cast("string"), F.lit("0"), F.col("doc_id").cast("string"), rel.cast("string")).alias("value"))
    return line(0, F.when(F.col("doc_id") % 3 == 0, F.lit(3)).otherwise(grade)).unionByName(line(1, grade).filter(F.split("value", " ")[2].cast("long") % 3 == 0))


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over every fifth document for each question, with ties, in the seven-column form."""
    d, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "benchmark").select("item_id")
    pairs = d.withColumn("m", F.col("doc_id") % 5).join(b.withColumn("m", F.col("item_id") % 5), "m")
    score = ((F.col("doc_id") * 37 + F.col("item_id") * 11) % 101) / 10
    return pairs.select((F.col("item_id") * 10_000_000 + F.col("doc_id")).alias("line_no"), F.concat_ws(" ", F.col("item_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.lit("1"), score.cast("string"), F.lit("x"), F.lit("bm25")).alias("value"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("pid"), "vec_id", F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter("vec_id % 20 = 0").select(F.col("pid").alias("qid"), "vector")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a batch result: answered, without choices, empty, malformed."""
    a = answers(spark, sf_dir)
    choice = F.array(F.struct(F.struct(F.col("answer").alias("content")).alias("message")))
    body = F.when(F.col("line_no") % 11 == 1, F.struct(F.slice(choice, 1, 0).alias("choices"))).otherwise(F.struct(choice.alias("choices")))
    value = F.when(F.col("line_no") % 11 == 2, F.lit("{ not json")).otherwise(F.to_json(F.struct(F.col("sample_id").alias("custom_id"), F.struct(body.alias("body")).alias("response"))))
    return a.select("line_no", value.alias("value"))


def run_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position, name, subset, run and the reported metrics: four methods with five runs each, each run's results evaluated
    by the judgements and averaged over three subsets of the questions."""
    d, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "benchmark").select("item_id")
    pairs = d.withColumn("m", F.col("doc_id") % 25).join(b.withColumn("m", F.col("item_id") % 25), "m").drop("m")
    ran = pairs.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(4))))
    score = ((F.col("doc_id") * (37 + 2 * F.col("position")) + F.col("item_id") * (11 + 3 * F.col("run"))) % 101) / 10
    results = ran.select(F.col("item_id").cast("string").alias("qid"), F.col("doc_id").cast("string").alias("pid"), score.alias("score"), "position", "run")
    found = evaluation.per_query(results, readers.qrels(judgement_lines(spark, sf_dir)), ("qid", "position", "run"))
    means = evaluation.summary(found.withColumn("subset", F.concat(F.lit("subset"), (F.col("qid").cast("long") % 3).cast("string"))), "position", "subset", "run")
    return means.withColumn("name", F.concat(F.lit("method"), F.col("position").cast("string")))
