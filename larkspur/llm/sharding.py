"""Operator 10: sharding by a k-d tree over metadata with distributed weighted medians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import hash_bits, materialise, read_table, running

BINS = 4096
OVERHEAD = 16


def coordinates(docs: DataFrame) -> DataFrame:
    """size, the metadata (length as log2 of the size; source and language by name), hashes and node 0 of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + OVERHEAD
    return docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.log2(size.cast("double")).alias("x0"), F.col("source").cast("string").alias("x1"), F.col("lang").cast("string").alias("x2"), hash_bits(text).alias("same"), hash_bits(F.col("doc_id"), F.lit("tie"), F.col("source")).alias("tie"), F.lit(0).alias("node"))


def ranks(own: DataFrame, name: str) -> DataFrame:
    """name, place: the rank (from 1) of each distinct value of a column, whole names in code-point order; nulls have none.

    Values are dealt by ranges and numbered inside; the ranges' counts come to the driver.
    """
    values = own.select(name).filter(F.col(name).isNotNull()).distinct()
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = materialise(values.repartitionByRange(tasks, name).sortWithinPartitions(name).select(name, F.spark_partition_id().alias("_p"), inside.alias("_i")), "ranks")
    counts = {r["_p"]: r["count"] for r in dealt.groupBy("_p").count().collect()}
    before, starts = 1, []
    for p in sorted(counts):
        starts.append((p, before))
        before += counts[p]
    table = own.sparkSession.createDataFrame(starts, "_p int, _start long")
    return dealt.join(F.broadcast(table), "_p").select(name, (F.col("_start") + F.col("_i")).cast("double").alias("place"))


DIMENSIONS = ("x0", "x1", "x2")


def _bin(value: Column, low: Column, high: Column) -> Column:
    """Which of BINS equal parts of [low, high] a value is in."""
    return F.when(high > low, F.least(F.floor((value - low) / (high - low) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")


#: Bins of a node's search, one inside the other: the coordinate, three parts of the text's hash, the row's own hash.
DEPTHS = 5
SPLIT = "node int, dim int, low double, high double, " + ", ".join(f"cut{i} int" for i in range(DEPTHS)) + ", left int, right int"


def _digits(same: int) -> list[int]:
    """The bins of the depths that go by the text's hash."""
    width = int(math.log2(BINS))
    return [same >> 63 - width * (i + 1) & BINS - 1 for i in range(DEPTHS - 2)]


def _with_bins(at: DataFrame, splits: list[dict]) -> DataFrame:
    """Rows of the nodes to split, with their splits (a table of one row a node, at most as many as shards) and three bins."""
    table = at.sparkSession.createDataFrame([tuple(s[c.split()[0]] for c in SPLIT.split(", ")) for s in splits], SPLIT)
    value = F.when(F.col("dim") == 0, F.col("x0")).when(F.col("dim") == 1, F.col("x1")).otherwise(F.col("x2"))
    width = int(math.log2(BINS))
    part = lambda name, i: F.shiftright(F.col(name), 63 - width * (i + 1)).bitwiseAND(F.lit(BINS - 1)).cast("int")
    hashed = {f"bin{1 + i}": part("same", i) for i in range(DEPTHS - 2)} | {f"bin{DEPTHS - 1}": part("tie", 0)}
    return at.join(F.broadcast(table), "node", "left").withColumns({"bin0": _bin(value, F.col("low"), F.col("high"))} | hashed)


def split_tree(points: DataFrame, leaves: int, whole: float = 0.02) -> DataFrame:
    """`points` (whose node is 0, the root) with shard, the leaf that each row comes to.

    A node that has to give k leaves sends k // 2 / k of its bytes to the left along its widest dimension, whose spread
    is the weighted standard deviation over that of the whole table. The median's place is found by histograms of BINS
    bins, each inside the bin of the one before that holds the median: of the coordinate, then of 36 bits of the text's
    hash, so that equal texts are a unit. A bin that holds one text alone needs no further histogram. That unit goes to
    the nearer side as a whole; only if it weighs more than `whole` of a leaf, a last histogram, of the rows' own hashes,
    splits it. What comes to the driver is a row a node, at most as many as shards.
    """
    frontier, base, next_id = [(0, 0, leaves)], None, 1  # node, first leaf, leaves
    at = points
    while any(n > 1 for _, _, n in frontier):
        stats = [F.sum("size").alias("w")]
        for i, x in enumerate(DIMENSIONS):
            v, w = F.col(x), F.col("size").cast("double")
            stats += [F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}"), F.sum(w * v).alias(f"s{i}"), F.sum(w * v * v).alias(f"q{i}")]
        found = {r["node"]: r for r in at.groupBy("node").agg(*stats).collect()}
        spread = lambda r, i: max(0.0, r[f"q{i}"] / r["w"] - (r[f"s{i}"] / r["w"]) ** 2) ** 0.5
        base = base or ([spread(found[0], i) or 1.0 for i in range(len(DIMENSIONS))] if found else [])
        splits, after = [], [f for f in frontier if f[2] == 1]
        for node, first, n in (f for f in frontier if f[2] > 1):
            r, k = found.get(node), n // 2
            if r:
                dim = max(range(len(DIMENSIONS)), key=lambda i: (round(spread(r, i) / base[i], 5), -i))  # sums of doubles differ by order
                splits.append({"node": node, "dim": dim, "low": r[f"low{dim}"], "high": r[f"high{dim}"], "want": r["w"] * k / n, "leaf": r["w"] / n, "done": 0, "next": 0, "left": next_id, "right": next_id + 1} | {f"cut{i}": 0 for i in range(DEPTHS)})
            after += [(next_id, first, k), (next_id + 1, first + k, n - k)]
            next_id += 2
        searched = splits
        for depth in range(DEPTHS):
            now = [s for s in searched if depth >= s["next"]]
            if not now:
                continue
            rows = _with_bins(at, now).filter(" and ".join(["dim is not null", *(f"bin{i} = cut{i}" for i in range(depth))]))
            bins = rows.groupBy("node", F.col(f"bin{depth}").alias("bin")).agg(F.sum("size").alias("w"), F.min("same").alias("low"), F.max("same").alias("high"))
            cuts = {r["node"]: r for r in _medians(bins, now).collect()}
            for s in now:
                cut, s["done"], weight, only = cuts[s["node"]][1:]
                s[f"cut{depth}"], at_depth = cut, depth
                if only is not None and depth < DEPTHS - 2:
                    at_depth = DEPTHS - 2
                    s |= {f"cut{1 + i}": d for i, d in enumerate(_digits(only)) if 1 + i > depth}
                s["next"] = at_depth + 1
                last = at_depth == DEPTHS - 1 or at_depth == DEPTHS - 2 and weight <= whole * s["leaf"]
                s[f"cut{at_depth}"] += last and s["done"] + weight - s["want"] < s["want"] - s["done"]
                s["next"] = DEPTHS if last else s["next"]
            searched = [s for s in searched if s["next"] < DEPTHS]
        left = F.lit(False)
        for i in reversed(range(DEPTHS)):
            left = (F.col(f"bin{i}") < F.col(f"cut{i}")) | ((F.col(f"bin{i}") == F.col(f"cut{i}")) & left)
        node = F.when(F.col("dim").isNull(), F.col("node")).when(left, F.col("left")).otherwise(F.col("right"))
        # written level by level: every level's plans are then alike, and short
        at = materialise(_with_bins(at, splits).withColumn("node", node).select(*points.columns), "nodes")
        frontier = after
    leaf = points.sparkSession.createDataFrame([(node, first) for node, first, _ in frontier], "node int, shard int")
    return at.join(F.broadcast(leaf), "node").drop("node")


def _medians(bins: DataFrame, splits: list[dict]) -> DataFrame:
    """node, cut, done, weight, only: of each node to split the bin in which its weight reaches what is wanted on the left,
    what lies before it, its weight, and its text's hash if it has one only; behind the last bin if none reaches it.

    Bins are summed up where they are: a node has at most BINS of them, and one row of each comes out.
    """
    wanted = bins.sparkSession.createDataFrame([(s["node"], float(s["want"]), float(s["done"])) for s in splits], "node int, want double, sofar double")
    upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = bins.join(F.broadcast(wanted), "node").withColumn("after", F.col("sofar") + F.sum("w").over(upto))
    only = F.when(F.col("low") == F.col("high"), F.col("low"))
    reached = F.when(F.col("after") >= F.col("want"), F.struct("bin", (F.col("after") - F.col("w")).alias("done"), "w", only.alias("only")))
    found = summed.groupBy("node").agg(F.min(reached).alias("r"), F.struct((F.max("bin") + 1).alias("bin"), F.max("after").alias("done"), F.lit(0).cast("long").alias("w"), F.lit(None).cast("long").alias("only")).alias("none"))
    return found.select("node", F.coalesce("r", "none").alias("r")).select("node", "r.*")


def shard(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of `docs` (doc_id, text, source, lang).

    Give the number of shards, or the bytes that a shard should have. Size: UTF-8 bytes of the text (null: none) plus 16.
    Shards get near equal bytes. Equal texts share their coordinates (the least of each among them), so they stay together
    but for those that outweigh a share of a shard, where a cut falls among them. Slots are gapless from 0 in each shard,
    in a fixed pseudo-random order. Source and language count by the rank of the whole name among all, null first.
    Null texts are empty; repeated rows stay; an empty table gives no rows.
    """
    own = materialise(coordinates(docs), "own")
    for name in ("x1", "x2"):
        own = own.join(ranks(own, name), name, "left").drop(name).withColumnRenamed("place", name).fillna(0.0, [name])
    own = materialise(own, "ranked")
    rows, total, *ends = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), *[f(x) for x in DIMENSIONS for f in (F.min, F.max)]).first()
    scaled = lambda x, low, high: (F.min(x) - F.lit(low)) / F.lit((high - low) or 1.0)
    alike = own.groupBy("same").agg(*[scaled(x, ends[2 * i] or 0.0, ends[2 * i + 1] or 0.0).alias(x) for i, x in enumerate(DIMENSIONS)])
    points = materialise(own.drop(*DIMENSIONS).join(alike, "same"), "points")
    shards = shards or max(1, math.ceil(total / target_bytes))
    placed = materialise(split_tree(points, shards).select("doc_id", "size", "text_crc32", "shard", "same", "tie"), "placed")
    return running(placed, ["shard"], ["same", "doc_id", "tie"], rows, "slot").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in 40 shards of near equal bytes, a row for each row; `grown_shard` is null under this law.

    Null texts are empty (16 bytes); null metadata sort first; repeated rows are rows of their own; further columns play
    no part; an empty table gives no rows.
    """
    out = shard(read_table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLE_SQL: dict[str, str] = {}
