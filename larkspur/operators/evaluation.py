"""Ranked-retrieval metrics by the usual TREC rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur import schemas
from larkspur.functions.text import base_id, last_segment

RECALLS, GAINS, PRECISION = (5, 10, 20, 1000), (3, 5, 1000), 20


def per_query(run: DataFrame, qrels: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """One row for each key that has both results and judgements: map, recip_rank, recall_k, P_20, ndcg_cut_k.

    run: keys, pid, score; qrels: qid, pid, rel (graded), hit (0/1). Results stand by score (as a single float) and, among
    equal ones, by pid, both descending; unjudged ones are not relevant; negative grades gain nothing. Every metric comes
    from one pass over the ranked rows. `keys` start with qid and may add more (a fact's number).
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("score").cast("float")), F.desc(F.col("pid").cast("string")))
    gain = F.greatest(F.coalesce("rel", F.lit(0)), F.lit(0)).cast("double")
    joined = run.select(*keys, "pid", "score").join(qrels.select("qid", "pid", "rel", "hit"), ["qid", "pid"], "left")
    ranked = joined.withColumn("rank", F.row_number().over(order)).withColumn("hit", F.coalesce("hit", F.lit(0)))
    ranked = ranked.withColumn("hits", F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    upto = lambda k, value: F.sum(F.when(F.col("rank") <= k, value).otherwise(F.lit(0.0)))
    discount = F.log2(F.col("rank") + 1)
    seen = ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(F.lit(0.0))).alias("ap"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        *[upto(k, F.col("hit").cast("double")).alias(f"hits_{k}") for k in sorted({*RECALLS, PRECISION})],
        *[upto(k, gain / discount).alias(f"dcg_{k}") for k in GAINS],
    )
    # judgements of one grade gain alike, so the best order is known from how many there are of each grade
    graded = qrels.groupBy("qid", "rel").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    graded = graded.withColumn("to", F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("to") - F.col("n") + 1)
    held = lambda k: F.when(F.col("from") <= k, F.aggregate(F.sequence("from", F.least("to", F.lit(k).cast("long"))), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1))).otherwise(F.lit(0.0))
    ideal = graded.groupBy("qid").agg(F.sum("hits").alias("relevant"), *[F.sum(gain * held(k)).alias(f"ideal_{k}") for k in GAINS])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return seen.join(ideal, "qid").select(
        *keys,
        share("ap", "relevant").alias("map"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("recip_rank"),
        *[share(f"hits_{k}", "relevant").alias(f"recall_{k}") for k in RECALLS],
        (F.col(f"hits_{PRECISION}") / PRECISION).alias(f"P_{PRECISION}"),
        *[share(f"dcg_{k}", f"ideal_{k}").alias(f"ndcg_cut_{k}") for k in GAINS],
    )


#: Reported name of each per-query metric.
REPORTED = dict(zip(schemas.METRICS, ("recip_rank", "ndcg_cut_3", "ndcg_cut_5", "ndcg_cut_1000", "P_20", "recall_20", "recall_1000", "map"), strict=True))


def summary(metrics: DataFrame, *by: str, digits: int = 5) -> DataFrame:
    """Means over the rows (of each `by`) times 100, rounded half to even, under the reported names."""
    mean = lambda c: F.bround(F.avg(c) * 100, digits)
    return metrics.groupBy(*by).agg(*[mean(c).alias(name) for name, c in REPORTED.items()])


def on_subset(metrics: DataFrame, ids: DataFrame) -> DataFrame:
    """Metrics of the queries in a subset: metrics are per query, so they are computed once and picked afterwards."""
    return metrics.join(ids.select("qid").distinct(), "qid", "left_semi")


def split_automatic(run: DataFrame) -> DataFrame:
    """A run over ids that end in a fact's number: qid without it, ptkb."""
    return run.withColumn("ptkb", last_segment(F.col("qid"))).withColumn("qid", base_id(F.col("qid")))


def best_fact(metrics: DataFrame, first_seen: DataFrame, always: bool = False) -> DataFrame:
    """Of each qid the fact with the best nDCG@3, among equal ones the first seen in the run; with `always`, never fact 0.

    A qid with fact 0 only has no row then.
    """
    rows = metrics.join(first_seen, "ptkb")
    rows = rows.filter("ptkb <> '0'") if always else rows
    order = Window.partitionBy("qid").orderBy(F.desc("ndcg_cut_3"), "first_seen")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "first_seen")


def first_seen(split_run: DataFrame) -> DataFrame:
    return split_run.groupBy("ptkb").agg(F.min("line_no").alias("first_seen"))


def long_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, value"""
    return rows.unpivot(list(keys), list(schemas.METRICS), "metric", "value")


def run_statistics(values: DataFrame, *keys: str) -> DataFrame:
    """min, max, mean, std, variance (both of the population), median of value over runs."""
    v = F.col("value")
    return values.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("variance"), F.median(v).alias("median"))


def t_probability(t: Column, degrees: int) -> Column:
    """Two-sided probability of Student's t for even degrees of freedom: a finite sum."""
    if degrees % 2 or degrees < 2:
        raise ValueError("even degrees of freedom only")
    theta = F.atan(F.abs(t) / F.sqrt(F.lit(float(degrees))))
    total, factor = F.lit(1.0), 1.0
    for j in range(1, degrees // 2):
        factor *= (2 * j - 1) / (2 * j)
        total = total + factor * F.pow(F.cos(theta), F.lit(2.0 * j))
    return 1 - F.sin(theta) * total


def t_tests(stats: DataFrame, n: int = 5, metrics: tuple[str, ...] = ("MRR", "NDCG@3", "NDCG@5", "MAP"), sample_std: bool = False) -> DataFrame:
    """name1, name2, subset, metric, t, p of all pairs of names (order: position), from mean and std over n runs each.

    The std that comes in is the population's and is used as it is; `sample_std` corrects it. Without variance in either
    both t and p are null.
    """
    rows = stats.filter(F.col("metric").isin(*metrics)).select("position", "name", "subset", "metric", "mean", "std")
    # names of a subset and metric are few; paired where they stand, so that what they come from is not computed for both sides
    each = rows.filter("subset is not null").groupBy("subset", "metric").agg(F.collect_list(F.struct("position", "name", "mean", "std")).alias("all"))
    pairs = each.select("subset", "metric", "all", F.explode("all").alias("a")).select("subset", "metric", "a", F.explode(F.filter("all", lambda x: x["position"] > F.col("a.position"))).alias("b"))
    pairs = pairs.select("subset", "metric", *[F.col(f"{side}.{c}").alias(f"{as_}{i}") for i, side in enumerate("ab", 1) for c, as_ in (("name", "name"), ("mean", "m"), ("std", "s"))])
    scale = n / (n - 1) if sample_std else 1.0
    pooled = (F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2")) * (scale / 2)
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (2.0 / n)))
    return pairs.withColumn("t", t).withColumn("p", t_probability(F.col("t"), 2 * n - 2)).select("name1", "name2", "subset", "metric", "t", "p")


def significant(tests: DataFrame, level: float = 0.05) -> DataFrame:
    return tests.filter(F.col("p") < level)
