"""Exact inner-product retrieval that leaves out blocks of passages which a bound rules out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import storage
from larkspur.operators.dense import BLOCK, CLOSE, best_of, group_count, group_of, packed

HITS = "qid string, pid string, score double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 0))


def cells(passages: DataFrame, most: int, sample: int) -> DataFrame:
    """`passages` (pid, vector) with cell: the nearest of at most `most` centres of unit vectors.

    Centres are found on at most `sample` vectors, those with the smallest hashes; they only say which vectors stand
    together, and whatever they are the search is exact.
    """
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = passages.withColumn("_unit", array_to_vector(F.transform("vector", lambda x: F.when(size > 0, x / size).otherwise(x))))
    some = unit.orderBy(F.xxhash64("vector")).limit(sample)
    model = KMeans(k=most, maxIter=8, seed=1, featuresCol="_unit", predictionCol="cell").fit(some)
    return model.transform(unit).drop("_unit")


def blocks(passages: DataFrame, path: str, most_cells: int = 1024, block: int = BLOCK, sample: int = 16_384) -> DataFrame:
    """Passages of one cell in blocks of about `block` rows, written to `path`: block, n, centre, radius, pids, x.

    Every vector of a block is within `radius` of its centre, so its product with a query q is at most that of the
    centre plus |q| times the radius (Cauchy and Schwarz).
    """
    rows = passages.filter("vector is not null").select(F.col("pid").cast("string").alias("pid"), F.col("vector").cast("array<double>").alias("vector"))
    n = rows.count()
    many = max(1, min(most_cells, n // max(1, block)))
    dealt = storage.kept(cells(rows, many, sample) if many > 1 else rows.withColumn("cell", F.lit(0)), f"{path}-cells")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))  # a row a cell
    numbered = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("vector", "pid"), F.col("parts")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("vector"))
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max())) * (1 + 1e-12)
        name = f"{table.column('cell')[0].as_py()}-{table.column('part')[0].as_py()}"
        return pa.table({"block": [name], "n": pa.array([len(x)], pa.int64()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius], "pids": pa.array([table.column("pid").to_pylist()], pa.list_(pa.string())), "x": pa.array([x.tobytes()], pa.binary())})

    made = numbered.groupBy("cell", "part").applyInArrow(pack, "block string, n long, centre array<double>, radius double, pids array<string>, x binary")
    return storage.kept(made, path)


def _grouped(pairs: DataFrame, groups: int) -> DataFrame:
    """Queries (block, qid, vector) of each block in groups of about QUERIES: block, qids, q."""

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"block": table.column("block").slice(0, 1), "qids": pa.array([table.column("qid").to_pylist()], pa.list_(pa.string())), "q": pa.array([_matrix(table.column("vector")).tobytes()], pa.binary())})

    salted = pairs.withColumn("salt", group_of("qid", groups))
    return salted.groupBy("block", "salt").applyInArrow(pack, "block string, qids array<string>, q binary")


def _best(found: DataFrame, pairs: DataFrame, groups: int, k: int) -> DataFrame:
    """qid, pid, score: of each pair of query and block the k best, ties to the smaller pid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pids, qids = (np.array(batch.column(c)[i].as_py(), object) for c in ("pids", "qids"))
                x, q = (np.frombuffer(batch.column(c)[i].as_py()).reshape(len(n), -1) for c, n in (("x", pids), ("q", qids)))
                scores, names = np.round(q @ x.T, 6), pids.astype(str)
                out: tuple[list, list, list] = ([], [], [])
                for qid, s in zip(qids, scores):
                    take = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                    take = take[np.lexsort((names[take], -s[take]))][:k]
                    for column, values in zip(out, ([qid] * len(take), pids[take], s[take])):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["qid", "pid", "score"])

    return found.select("block", "pids", "x").join(_grouped(pairs, groups).hint("merge"), "block").select("pids", "x", "qids", "q").mapInArrow(run, HITS)


def _bounded(found: DataFrame, queries: DataFrame, groups: int, least: int | None, grouped: bool = False) -> DataFrame:
    """Pairs (block, qid) by their bounds: with `least` each query's best blocks that hold so many rows (of each group of
    blocks that meet), else all whose bound reaches the query's floor; with `grouped` pairs (block, g) of a block and a
    group that has such a query.

    Blocks' centres meet queries in groups by an equality join, so a bound costs what a row costs in a plain search.
    """
    tables = max(1, -(-found.count() // BLOCK))

    def centres(table: pa.Table) -> pa.Table:
        return pa.table({"g": table.column("g").slice(0, 1), "blocks": pa.array([table.column("block").to_pylist()], pa.list_(pa.string())), "ns": pa.array([table.column("n").to_pylist()], pa.list_(pa.int64())), "radii": pa.array([table.column("radius").to_pylist()], pa.list_(pa.float64())), "c": pa.array([_matrix(table.column("centre")).tobytes()], pa.binary())})

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"salt": table.column("salt").slice(0, 1), "qids": pa.array([table.column("qid").to_pylist()], pa.list_(pa.string())), "floors": pa.array([table.column("floor").to_pylist()], pa.list_(pa.float64())), "q": pa.array([_matrix(table.column("vector")).tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, qids = (np.array(batch.column(c)[i].as_py(), object) for c in ("blocks", "qids"))
                c, q = (np.frombuffer(batch.column(x)[i].as_py()).reshape(len(n), -1) for x, n in (("c", names), ("q", qids)))
                ns, radii, floors = (np.array(batch.column(x)[i].as_py(), np.float64) for x in ("ns", "radii", "floors"))
                bounds = q @ c.T + np.linalg.norm(q, axis=1)[:, None] * radii
                if least is None:
                    at, to = np.nonzero(bounds >= floors[:, None] - CLOSE)
                else:
                    order = np.argsort(-bounds, axis=1, kind="stable")
                    before = np.cumsum(ns[order], axis=1) - ns[order]
                    at, nth = np.nonzero(before < least)
                    to = order[at, nth]
                if grouped:
                    to = np.unique(to)
                    yield pa.RecordBatch.from_arrays([pa.array(names[to], pa.string()), pa.array([batch.column("salt")[i].as_py()] * len(to), pa.int32())], names=["block", "g"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(names[to], pa.string()), pa.array(qids[at], pa.string())], names=["block", "qid"])

    meta = found.select("block", "n", "centre", "radius").withColumn("g", F.pmod(F.xxhash64("block"), F.lit(tables)).cast("int"))
    centred = meta.groupBy("g").applyInArrow(centres, "g int, blocks array<string>, ns array<long>, radii array<double>, c binary")
    asked = queries.withColumn("salt", group_of("qid", groups)).groupBy("salt").applyInArrow(pack, "salt int, qids array<string>, floors array<double>, q binary")
    meet = centred.join(asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).hint("merge"), "g")
    pairs = meet.select("blocks", "ns", "radii", "c", "qids", "floors", "q", "salt").mapInArrow(run, "block string, g int" if grouped else "block string, qid string")
    return pairs.distinct() if grouped else pairs


def search(found: DataFrame, queries: DataFrame, k: int, report: dict | None = None) -> DataFrame:
    """qid, pid, score (6 places), rank: the same rows as `dense.topk`, from `blocks`.

    First each query meets the blocks of best bounds that hold k rows; its k-th best score there is its floor. Then each
    group of queries is sent those blocks whose bound reaches the floor of one of them, and there a block meets only the
    queries whose floor, which rises on the way, it reaches (`dense.best_of`); all others cannot hold one of their k best.
    Pairs of query and block are never rows, and hits that are shuffled are k a query. Null query vectors have no rows.
    `report` gets the number of all pairs of query and block, and of those whose bound reaches the first floor or that
    were met to find it.
    """
    spark, work = queries.sparkSession, storage.scratch(queries.sparkSession, "dense")
    storage.small_batches(spark)
    asked = queries.filter("vector is not null").select(F.col("qid").cast("string").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    asked = storage.kept(asked, f"{work}/queries")
    groups = group_count(asked)
    first = storage.kept(_bounded(found, asked.withColumn("floor", F.lit(0.0)), groups, k), f"{work}/first")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "pid")
    top = lambda hits: hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    hits = _best(found, first.join(asked.hint("merge"), "qid").select("block", "qid", "vector"), groups, k)
    floors = top(hits).groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score") - CLOSE).otherwise(F.lit(float("-inf"))).alias("floor"))
    floored = asked.join(floors.hint("merge"), "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    floored = storage.kept(floored, f"{work}/floored")
    needed = _bounded(found, floored, groups, None, grouped=True)
    sent = found.join(needed.hint("merge"), "block").select("g", F.lit(0).alias("part"), F.col("pids").alias("keys"), "x", F.lit(False).alias("single"), "centre", "radius")
    own = packed(floored.withColumnRenamed("floor", "floors"), "qid", group_of("qid", groups), "floors").withColumnRenamed("part", "g").withColumn("part", F.lit(0))
    if report is not None:
        reached = _bounded(found, floored, groups, None).union(first.select("block", "qid")).distinct()
        report |= {"pairs": asked.count() * found.count(), "multiplied": reached.count()}
    return top(best_of(own, sent, groups, 1, k).drop("block"))


def topk(passages: DataFrame, queries: DataFrame, k: int, report: dict | None = None, **params) -> DataFrame:
    """`search` over blocks that are made for it; keep `blocks` for more than one search."""
    return search(blocks(passages, storage.scratch(passages.sparkSession, "blocks"), **params), queries, k, report)
