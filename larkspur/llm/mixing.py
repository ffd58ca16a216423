"""Operator 3: mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, boxed, materialise, read_table, running, unboxed

#: Plans of more sources than this are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 10_000


def water_fill(sizes: list[int], weights: list[float], total: float, most: float = 3.0) -> list[float]:
    """Shares of `total` by weight; none is above `most` times its size, and what is cut off is shared anew by weight."""
    targets, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > most * sizes[i]]
        for i in full or free:
            targets[i] = float(most * sizes[i]) if full else weights[i] * unit
        left -= sum(targets[i] for i in full)
        free = [i for i in free if i not in set(full)] if full else []
    return targets


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (sources x shards), drawn without replacement down a binary tree of shards.

    A node that stands for n shards gives the half with k of them k/n of its blocks; which sources those come from is
    one multivariate-hypergeometric draw. Row sums are the quotas exactly; column sums differ by at most the tree's depth.
    """
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def descend(first: int, n: int, have: np.ndarray) -> None:
        if n == 1:
            out[:, first] = have
            return
        k, total = n // 2, int(have.sum())
        rng = np.random.default_rng([seed, first, n])
        left = rng.multivariate_hypergeometric(have, total * k // n, method="marginals") if total else np.zeros_like(have)
        descend(first, k, left)
        descend(first + k, n - k, have - left)

    if len(quotas):
        descend(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def _stride(n: int, seed: int) -> tuple[int, int]:
    """a, c of the permutation b -> (a b + c) mod n of n blocks; the last block stays last."""
    if n <= 2:
        return 1, 0
    a = max(1, int(n * 0.6180339887) + seed % 7) % n or 1
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a, (n - 1) * (1 - a) % n


@dataclass
class Source:
    """What the plan says of a source; its blocks have `block` words each, the last one maybe less."""

    key: str
    size: int  # words
    target: float
    take: int  # words to take
    full: int  # whole rounds
    blocks: int
    block: int
    quota: int  # blocks of the round that is not whole

    @classmethod
    def of(cls, key: str, size: int, target: float, block_words: int) -> Source:
        take = round(target)
        blocks = max(1, -(-size // block_words))
        block = max(1, -(-size // blocks))
        full, rest = divmod(take, size) if size else (0, 0)
        return cls(key, size, target, take, full, blocks, block, -(-rest // block))


def plan(sources: list[Source], shards: int, seed: int, tree=split_tree) -> list[tuple]:
    """Of each source what its rows need to know their draws by: the permutations and the shards' stretches of them.

    The blocks of whole rounds and those of the last round are two rows of quotas that `tree` deals to the shards. In a
    whole round shard after shard takes its quota of the permuted blocks. Of the last round's permuted blocks each shard
    has a stretch in proportion to its quota, and draws the stretch's first ones, as many as its quota says: which blocks
    are drawn follows from the tree. `last` is the permuted place of the last block drawn, `cut` the words it gives up.
    """
    quotas = np.array([[s.full * s.blocks for s in sources], [s.quota for s in sources]], dtype=np.int64).T.reshape(-1)
    dealt = tree(quotas, shards, seed).reshape(len(sources), 2, shards)
    rows = []
    for s, (whole, drawn) in zip(sources, dealt):
        upto = np.cumsum(drawn) - drawn
        starts = upto * s.blocks // max(1, s.quota)
        some = np.flatnonzero(drawn)
        last = int(starts[some[-1]] + drawn[some[-1]] - 1) if len(some) else -1
        cut = min(s.quota * s.block, s.size) - (s.take - s.full * s.size) if s.quota else 0
        a, c = _stride(s.blocks, seed)
        wa, wc = _stride(max(1, s.full * s.blocks), seed + 1)
        rows.append((s.key, s.size, s.target, s.full, s.blocks, s.block, a, c, wa, wc, np.cumsum(whole).tolist(), starts.tolist(), drawn.tolist(), last, cut))
    return rows


PLAN = "key string, source_size long, target double, full long, blocks long, block long, a long, c long, wa long, wc long, upto array<long>, starts array<long>, drawn array<long>, last long, cut long"
DRAW = "array<struct<round:long,block:long,shard:int,from:long,words:long,shuffle:long>>"


def _placed(docs: DataFrame, shards: int, block_words: int, seed: int, most: float, tree) -> DataFrame:
    """`docs` (doc_id, text, _source, and _row if rows are to be carried) with the plan's columns, size and `draws`.

    Without _row texts are read once, to count their words, and only the counts are ranked.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.when(F.col("_source").isNull(), F.lit("N")).otherwise(F.concat(F.lit("S"), F.col("_source").cast("string")))
    rows = docs.select("*", key.alias("key"), size.alias("size"), F.xxhash64("text").alias("tie"))
    carried = "_row" in docs.columns
    narrow = materialise(rows.select("doc_id", "key", "size", "tie", *([] if carried else ["_source"])), "mix")
    totals = {r["key"]: (r["words"], r["rows"]) for r in narrow.groupBy("key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()}
    names = sorted(totals, key=lambda k: (k == "N", k))
    sizes, n = [totals[k][0] for k in names], sum(n for _, n in totals.values())
    targets = water_fill(sizes, [i % 3 + 1 for i in range(len(names))], sum(sizes), most)
    table = spark.createDataFrame(plan([Source.of(*x, block_words) for x in zip(names, sizes, targets)], shards, seed, tree), PLAN)
    placed = running(rows if carried else narrow, ["key"], ["doc_id", "tie", "size"], n, "rank", "size", "before", narrow=narrow)
    joined = placed.join(F.broadcast(table) if len(names) <= BROADCAST_SOURCES else table, "key")
    shuffle = lambda *by: F.xxhash64(F.lit(seed), *by, F.col("key"), F.col("rank"))
    first = F.floor(F.col("before") / F.col("block"))

    def whole(r):
        at = (F.col("wa") * (r * F.col("blocks") + first) + F.col("wc")) % (F.col("full") * F.col("blocks"))
        shard = F.size(F.filter("upto", lambda x: x <= at))
        return F.struct(r.alias("round"), first.alias("block"), shard.alias("shard"), F.lit(0).cast("long").alias("from"), F.col("size").alias("words"), shuffle(r, F.lit(0).cast("long")).alias("shuffle"))

    def piece(b):
        """What block b holds of the row, if it is drawn: shard, first word, words."""
        at = (F.col("a") * b + F.col("c")) % F.col("blocks")
        shard = F.size(F.filter("starts", lambda x: x <= at)) - 1
        low = F.greatest(b * F.col("block"), F.col("before"))
        high = F.least((b + 1) * F.col("block") - F.when(at == F.col("last"), F.col("cut")).otherwise(0), F.col("before") + F.col("size"), F.col("source_size") - F.when((at == F.col("last")) & (b == F.col("blocks") - 1), F.col("cut")).otherwise(0))
        drawn = at - F.get("starts", shard) < F.get("drawn", shard)
        return F.struct(b.alias("block"), shard.alias("shard"), (low - F.col("before")).alias("from"), F.when(drawn, high - low).otherwise(F.lit(0)).alias("words"))

    def join(acc, p):
        """Pieces that follow each other stay one, where the first of them goes."""
        end = F.element_at(acc, -1)
        follows = (F.size(acc) > 0) & (end["from"] + end["words"] == p["from"])
        grown = F.struct(end["block"].alias("block"), end["shard"].alias("shard"), end["from"].alias("from"), (end["words"] + p["words"]).alias("words"))
        return F.when(p["words"] <= 0, acc).when(follows, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(p)))

    none = F.array().cast("array<struct<block:bigint,shard:int,from:bigint,words:bigint>>")
    over = F.floor((F.col("before") + F.col("size") - 1) / F.col("block"))
    pieces = F.aggregate(F.transform(F.sequence(first, over), piece), none, join)
    partly = F.transform(pieces, lambda p: F.struct(F.col("full").alias("round"), p["block"].alias("block"), p["shard"].alias("shard"), p["from"].alias("from"), p["words"].alias("words"), shuffle(F.col("full"), p["from"]).alias("shuffle")))
    rounds = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), whole)).otherwise(F.array().cast(DRAW)).cast(DRAW)
    draws = F.when(F.col("size") > 0, F.concat(rounds, F.when(F.col("last") >= 0, partly).otherwise(F.array().cast(DRAW)).cast(DRAW))).otherwise(F.array().cast(DRAW))
    return joined.withColumn("draws", draws)


def mix(docs: DataFrame, shards: int = 16, block_words: int = 4096, seed: int = 17, most: float = 3.0, tree=split_tree) -> DataFrame:
    """The mixture of `docs` (doc_id, text, source): one row per input row with its draws.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all words; no source is taken more than
    `most` times. A source's documents stand in one fixed pseudo-random order, cut into blocks of about `block_words`
    words. Its target is so many whole rounds and a number of blocks of one more round. `tree` deals these exact block
    quotas to the shards, which draw disjoint blocks of a permutation (see `plan`); the last block drawn is cut so that
    the words taken are the rounded target. A document in a whole round goes to its first block's shard; in the other
    round it gives what lies in drawn blocks, in one piece where these follow each other. Inside a shard, order by
    `shuffle` (it is random) for the local shuffle.

    Returns doc_id, source, tie (hash of the text), size, source_size, target, draws: array of (round, block, shard, from,
    words, shuffle). Null or empty texts have size 0 and no draws; a null source is a source of its own; repeated rows
    are documents of their own. An empty table gives no rows. The same rows come for any partitioning. Driver: one row
    per source (the mixture's own table).
    """
    rows = docs.select("doc_id", "text", F.col("source").alias("_source"))
    return _placed(rows, shards, block_words, seed, most, tree).select("doc_id", F.col("_source").alias("source"), "tie", "size", "source_size", "target", "draws")


def mixed_documents(docs: DataFrame, shards: int = 16, block_words: int = 4096, seed: int = 17, most: float = 3.0, tree=split_tree, part_rows: int = 50_000) -> DataFrame:
    """The mixture itself: the columns of `docs`, a row for each draw, shard by shard, shuffled inside each.

    Rows carry their own draws, so rows alike in id and text but of another source are drawn at their own source's rate.
    A draw of part of a document has its words joined by single spaces, and `n_chars` (if there) says the new length.
    Shards are written in pieces of about `part_rows` rows, by leading bits of the shuffle's key; a partition may hold
    several pieces, each one sorted by that key.
    """
    rows = boxed(docs).withColumn("_source", F.col("_row.source"))
    placed = _placed(rows, shards, block_words, seed, most, tree)
    out = placed.select("doc_id", "text", "_row", "size", F.inline("draws"))
    words = F.slice(F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0)), (F.col("from") + 1).cast("int"), F.col("words").cast("int"))
    cut = F.col("words") < F.col("size")
    out = out.withColumn("_cut", cut).withColumn("text", F.when(cut, F.array_join(words, " ")).otherwise(F.col("text")))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, math.ceil(tasks / shards), math.ceil(docs.count() / part_rows / shards))
    part = F.floor((F.col("shuffle") / 2.0**64 + 0.5) * parts)
    out = out.withColumn("_part", part).repartition(max(tasks, shards * parts), "shard", "_part").sortWithinPartitions("shard", "_part", "shuffle")
    changed = {"n_chars": F.when(F.col("_cut"), F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {}
    return unboxed(out, docs.columns, **changed)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and draws of all `documents`, a row for each row.

    `draws` lists "round:block:shard:first word:words:shuffle" of each draw, comma-joined, in this order; '' for none.
    Null texts are empty, empty ones are never drawn; a null source is one of its own; repeated rows are rows of their
    own; further columns play no part; an empty table gives no rows.
    """
    mixed = mix(read_table(spark, sf_dir, "documents"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    told = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", *[d[k].cast("string") for k in ("round", "block", "shard", "from", "words", "shuffle")])), ",")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), told.alias("draws"))


QUERIES = {"op3_mixing": op3_mixing}
ORACLE_SQL: dict[str, str] = {}
