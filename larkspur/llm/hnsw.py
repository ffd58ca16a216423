"""Operator 7: approximate nearest neighbours by one navigable small-world graph a shard, kept as flat neighbour arrays."""

from __future__ import annotations

import functools
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import hash_bits, materialise, read_table, scratch_path, small_batches
from larkspur.llm.files import map_file, write_file

SHARD_VECTORS, BLOCK_QUERIES = 8192, 512


class Graph:
    """A hierarchical graph over unit-like vectors (equal norms), nearest being the largest inner product.

    Nodes stand by level, highest first, so layer l is the nodes below sizes[l]; links[l] is an int32 array (sizes[l] x
    degree), -1 where there is none. Nodes are added in batches: a batch searches the graph so far, its members see each
    other by a block product, and links are picked by the usual diversity rule, in both directions.
    """

    def __init__(self, vectors: np.ndarray, sizes: list[int], links: list[np.ndarray]):
        self.vectors, self.sizes, self.links = vectors, sizes, links

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = 16, breadth: int = 64, seed: int = 7) -> tuple[Graph, np.ndarray]:
        """The graph and the order in which it holds the vectors."""
        n = len(vectors)
        levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(degree)).astype(int)
        order = np.argsort(-levels, kind="stable")
        levels = levels[order]
        top = int(levels[0]) if n else 0
        sizes = [int((levels >= level).sum()) for level in range(top + 1)]
        graph = cls(np.ascontiguousarray(vectors[order], np.float32), sizes, [np.full((m, degree * (1 + (level == 0))), -1, np.int32) for level, m in enumerate(sizes)])
        for level in range(top, -1, -1):
            done = 0
            while done < sizes[level]:
                first = max(256, sizes[level + 1] if level < top else 0)
                upto = min(sizes[level], done + (min(done, 1024) if done else first))
                graph._insert(level, done, upto, degree, breadth)
                done = upto
        return graph, order

    def _insert(self, level: int, done: int, upto: int, degree: int, breadth: int) -> None:
        links = self.links[level]
        for lo in range(done, upto, 1024):
            new = np.arange(lo, min(upto, lo + 1024))
            own = self.vectors[new]
            near = own @ self.vectors[done:upto].T
            near[np.arange(len(new)), new - done] = -np.inf
            k = min(breadth, near.shape[1])
            pick = np.argpartition(-near, k - 1, axis=1)[:, :k]
            ids, scores = pick + done, np.take_along_axis(near, pick, 1)
            if done:
                found, far = self._beam(own, self._entries(own, level + 1), level, breadth, done)
                ids, scores = np.concatenate([ids, found], 1), np.concatenate([scores, far], 1)
            self._choose(level, new, ids, scores, degree)
        batch = np.repeat(np.arange(done, upto), links.shape[1])
        to = links[done:upto].ravel()
        batch, to = batch[to >= 0], to[to >= 0]
        self._link_back(level, to, batch)

    def _choose(self, level: int, nodes: np.ndarray, ids: np.ndarray, scores: np.ndarray, degree: int) -> None:
        """Links of `nodes` out of candidates: nearest first, skipping those nearer to one already taken; then the nearest skipped."""
        keep = min(64, ids.shape[1])
        best = np.argsort(-np.where(ids < 0, -np.inf, scores), axis=1, kind="stable")[:, :keep]
        ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
        valid = (ids >= 0) & np.isfinite(scores)
        for lo in range(0, len(nodes), 256):
            i, s, ok = ids[lo : lo + 256], scores[lo : lo + 256], valid[lo : lo + 256]
            x = self.vectors[np.maximum(i, 0)]
            among = np.matmul(x, x.transpose(0, 2, 1))
            taken = np.zeros(i.shape, bool)
            for j in range(keep):
                nearer = (taken & (among[:, j, :] > s[:, j, None])).any(1)
                taken[:, j] = ok[:, j] & ~nearer & (taken.sum(1) < degree)
            rank = np.where(taken, 0, np.where(ok, 1, 2)) * keep + np.arange(keep)
            out = np.argsort(rank, axis=1)[:, :degree]
            picked = np.where(np.take_along_axis(ok, out, 1), np.take_along_axis(i, out, 1), -1)
            row = self.links[level][nodes[lo : lo + 256]]
            row[:] = -1
            row[:, : picked.shape[1]] = picked
            self.links[level][nodes[lo : lo + 256]] = row

    def _link_back(self, level: int, to: np.ndarray, source: np.ndarray) -> None:
        """Adds to -> source; a node with more links than there is room chooses anew (of its links and 64 nearest offers)."""
        links = self.links[level]
        if not len(to):
            return
        scores = np.einsum("ij,ij->i", self.vectors[to], self.vectors[source])
        order = np.lexsort((-scores, to))
        to, source, scores = to[order], source[order], scores[order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        nodes, owner = to[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(to))))
        some = rank < 64
        offers = np.full((len(nodes), 64), -1, np.int64)
        offers[owner[some], rank[some]] = source[some]
        offers[(offers[:, :, None] == links[nodes][:, None, :]).any(2)] = -1
        for lo in range(0, len(nodes), 1024):
            own = nodes[lo : lo + 1024]
            ids = np.concatenate([links[own].astype(np.int64), offers[lo : lo + 1024]], 1)
            scores = np.einsum("qd,qkd->qk", self.vectors[own], self.vectors[np.maximum(ids, 0)])
            self._choose(level, own, ids, scores, links.shape[1])

    def _entries(self, queries: np.ndarray, level: int) -> np.ndarray:
        """For each query the nearest node that a descent from the top down to `level` ends at."""
        at = np.zeros((len(queries), 1), np.int64)
        for layer in range(len(self.sizes) - 1, level - 1, -1):
            at = self._beam(queries, at, layer, 4, self.sizes[layer])[0][:, :1]
        return at

    def _beam(self, queries: np.ndarray, entries: np.ndarray, level: int, breadth: int, n: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer for all queries at once: ids and scores (queries x breadth), best first, -1 for none."""
        links, q = self.links[level], len(queries)
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, n + 1), bool)
        seen[:, n] = True
        seen[rows, entries] = True
        ids = np.full((q, breadth), -1, np.int64)
        scores = np.full((q, breadth), -np.inf, np.float32)
        ids[:, : entries.shape[1]] = entries
        scores[:, : entries.shape[1]] = np.einsum("qd,qkd->qk", queries, self.vectors[entries])
        open_ = ids >= 0
        live = np.arange(q)
        while len(live):
            first = np.argsort(~open_[live], axis=1, kind="stable")[:, :wide]
            r = live[:, None]
            go = open_[r, first]
            open_[r, first] = False
            nodes = np.where(go, ids[r, first], 0)
            near = np.where(go[:, :, None], links[nodes], -1).reshape(len(live), -1)
            near = np.where((near >= 0) & (near < n), near, n)
            near = np.where(seen[r, near], n, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            width = int((near < n).sum(1).max(initial=0))
            if width:
                near = np.sort(near, axis=1)[:, :width]
                seen[r, near] = True
                fresh = near < n
                got = np.einsum("qd,qkd->qk", queries[live], self.vectors[np.where(fresh, near, 0)])
                got = np.where(fresh, got, -np.inf)
                all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
                all_scores = np.concatenate([scores[live], got], 1)
                all_open = np.concatenate([open_[live], fresh], 1)
                best = np.argsort(-all_scores, axis=1, kind="stable")[:, :breadth]
                ids[live], scores[live], open_[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_scores, all_open))
            live = live[open_[live].any(1)]
        return ids, scores

    def search(self, queries: np.ndarray, breadth: int) -> np.ndarray:
        queries = np.ascontiguousarray(queries, np.float32)
        return self._beam(queries, self._entries(queries, 1), 0, breadth, self.sizes[0])[0]


def _valid(column: str) -> Column:
    x = F.col(column)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & good & F.exists(x, lambda v: v != 0)


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


@functools.lru_cache(maxsize=2)
def _load(uri: str) -> dict[str, np.ndarray] | None:
    raw = map_file(uri)
    if raw is None:
        return None
    with np.load(io.BytesIO(raw)) as file:
        return dict(file)


def _build(folder: str, norm: float, params: dict):
    """All vectors of one shard to the shard's file: vectors as they are, the graph, and the ids that hold each vector."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids = table.column("ids").to_pylist()
        rank = sorted(range(len(ids)), key=ids.__getitem__)
        x = np.stack(table.column("vector").to_numpy())[rank].astype(np.float64)
        graph, order = Graph.build(np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0.0))]) / norm, **params)
        ids = [ids[rank[i]] for i in order]
        offsets = np.cumsum([0, *map(len, ids)])
        links = {f"links{i}": a for i, a in enumerate(graph.links)}
        write_file(f"{folder}/{shard}", _pack({"x": x[order], "unit": graph.vectors, "sizes": np.array(graph.sizes), "ids": np.concatenate(ids), "offsets": offsets} | links))
        return pa.table({"shard": pa.array([shard], pa.int32())})

    return run


def _search(folder: str, top: int, breadth: int):
    """Query blocks, each against one shard: (query, vec_id, score) of the `top` best rows there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, queries, keys in zip(batch.column("shard").to_pylist(), batch.column("queries"), batch.column("keys")):
                file = _load(f"{folder}/{shard}")
                if file is None:  # a shard that got no vector
                    continue
                keys = keys.as_py()
                q = np.frombuffer(queries.as_py(), np.float64).reshape(len(keys), -1)
                graph = Graph(file["unit"], file["sizes"].tolist(), [file[f"links{i}"] for i in range(len(file["sizes"]))])
                found = graph.search(np.column_stack([q, np.zeros(len(q))]), breadth)
                scores = np.einsum("qd,qkd->qk", q, file["x"][np.maximum(found, 0)])
                scores[found < 0] = -np.inf
                order = np.argsort(-scores, axis=1, kind="stable")
                out = ([], [], [])
                for i, key in enumerate(keys):
                    hits = []
                    for j in order[i]:
                        s = scores[i, j]
                        if s == -np.inf or len(hits) >= top and s < hits[-1][0]:
                            break
                        a, b = file["offsets"][found[i, j] : found[i, j] + 2]
                        hits += [(s, v) for v in file["ids"][a:b].tolist()]
                    hits = sorted(hits, key=lambda h: (-h[0], h[1]))[:top]
                    out[0].extend([key] * len(hits))
                    out[1].extend(h[1] for h in hits)
                    out[2].extend(h[0] for h in hits)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["key", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, breadth: int = 128, degree: int = 16, build_breadth: int = 64, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (a row vec_id, embedding) its k nearest rows of `vectors` by inner product.

    Equal vectors are one node that knows its k + 1 smallest ids. Nodes are dealt to shards by hash, about
    `shard_vectors` each, and every shard gets a graph; a further coordinate makes all norms equal, so that the graph's
    nearest is the largest inner product. Blocks of distinct queries meet every shard (a query set against all rows, in
    blocks) and the shards' best are merged. A row is never its own neighbour; ties go to the smaller id. Scores are
    inner products in double precision. Vectors that are null, all zero, of another length than most, or hold null or
    non-finite components take no part, neither do rows without id; empty tables give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).filter(F.col("vec_id").isNotNull() & _valid("vector"))
    width = clean(vectors).groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = width[0]["width"] if width else 0
    key = F.md5(F.array_join(F.transform("vector", lambda v: (v + F.lit(0.0)).cast("string")), ",").cast("binary"))
    rows = clean(vectors).filter(F.size("vector") == width).withColumn("key", key)
    asked = materialise(clean(queries).filter(F.size("vector") == width).withColumn("key", key), "queries")
    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("_r") <= k + 1)
    nodes = materialise(few.groupBy("key").agg(F.any_value("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    n, norm = nodes.agg(F.count(F.lit(1)), F.sqrt(F.max(norm2))).first()
    shards = max(1, math.ceil(n / shard_vectors))
    folder = scratch_path(spark, "graphs")
    params = {"degree": degree, "breadth": build_breadth}
    built = nodes.withColumn("shard", (hash_bits(F.col("key")) % shards).cast("int")).groupBy("shard").applyInArrow(_build(folder, norm or 1.0, params), "shard int")
    built.count()
    distinct = asked.groupBy("key").agg(F.any_value("vector").alias("vector"))
    blocks = max(1, math.ceil(distinct.count() / BLOCK_QUERIES))

    def block(table: pa.Table) -> pa.Table:
        x = np.stack(table.column("vector").to_numpy()).astype(np.float64)
        return pa.table({"block": table.column("block").slice(0, 1), "keys": pa.array([table.column("key").to_pylist()], pa.list_(pa.string())), "queries": pa.array([x.tobytes()], pa.binary())})

    packed = distinct.withColumn("block", hash_bits(F.col("key"), F.lit(1)) % blocks).groupBy("block").applyInArrow(block, "block long, keys array<string>, queries binary")
    meet = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition("shard", "block")
    hits = meet.mapInArrow(_search(folder, k + 1, max(breadth, k + 1)), "key string, vec_id long, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    merged = hits.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r")
    own = asked.select(F.col("vec_id").alias("query_id"), "key").join(merged, "key").filter(F.col("query_id") != F.col("vec_id"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id 20 divides, among all others; see `nearest`.

    Null, zero and non-finite vectors, and rows without id, take no part; equal vectors are neighbours of each other; ties
    go to the smaller id; further columns play no part; an empty table gives no rows.
    """
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 20 = 0"))


QUERIES = {"op7_neighbours": op7_neighbours}
ORACLE_SQL: dict[str, str] = {}
