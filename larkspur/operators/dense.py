"""Exact inner-product retrieval and what belongs to it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from larkspur.operators import storage
from larkspur.operators.encoder import encoded

BLOCK = 4096
#: Rows that are multiplied at once, queries of one group, least number of groups.
ROWS, QUERIES, GROUPS = 1024, 1024, 32
#: Scores are rounded to six places, so what is this much below the k-th best cannot be among them.
CLOSE = 2e-6
HITS = "qid string, pid string, score double, block int"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def packed(rows: DataFrame, key: str, part: Column, *more: str) -> DataFrame:
    """Rows (key, vector) as part, keys, x (and lists of `more` columns of doubles): rows that stand together in a scan.

    Nothing is dealt for it, so copies of one vector are no one task's. Single floats stay such on the way.
    """
    single = isinstance(rows.schema["vector"].dataType.elementType, FloatType)
    kind, wire = ("float", "<f4") if single else ("double", "<f8")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for one in np.unique(parts):
                some = batch.filter(pa.array(parts == one))
                x = np.stack(some.column("vector").to_numpy(zero_copy_only=False)).astype(wire)
                columns = [pa.array([one], pa.int32()), pa.array([some.column("key").to_pylist()], pa.list_(pa.string())), pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([some.column(c).to_pylist()], pa.list_(pa.float64())) for c in more], names=["part", "keys", "x", *more])

    made = rows.select(F.col(key).cast("string").alias("key"), F.col("vector").cast(f"array<{kind}>").alias("vector"), part.cast("int").alias("part"), *more)
    return made.mapInArrow(pack, ", ".join(["part int, keys array<string>, x binary", *[f"{c} array<double>" for c in more]])).withColumn("single", F.lit(single))


def group_count(queries: DataFrame) -> int:
    """Groups of queries: as few as GROUPS while they have QUERIES at most, so each passage is sent that often."""
    n = queries.count()
    return max(1, min(GROUPS, n), -(-n // QUERIES))


def group_of(qid: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(F.col(qid).cast("string")), F.lit(groups)).cast("int")


class Best:
    """The k best passages of each query of a group, of all blocks met so far; ties go to the smaller pid.

    Kept are k hits a query and, between two cuts, about as many again; a query's floor is its k-th best score.
    """

    def __init__(self, qids: list, q: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.qids, self.q, self.k = np.array(qids, object), q, k
        self.norms = np.linalg.norm(q, axis=1)
        self.floors = np.full(len(q), -np.inf) if floors is None else floors
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, 2 * k * len(q) + (1 << 16)

    def meet(self, keys: list, x: np.ndarray, who: np.ndarray) -> None:
        """Multiplies passages with the queries at the places `who`."""
        pids = np.array([b"\xff" if p is None else p.encode() for p in keys])  # ordered as text is
        for at in range(0, len(pids), ROWS):
            scores = np.round(self.q[who] @ x[at : at + ROWS].T, 6)
            i, j = np.nonzero(scores >= self.floors[who][:, None])
            self.found.append((who[i], scores[i, j], pids[at + j]))
            self.held += len(i)
            if self.held > self.most:
                self.cut()

    def cut(self) -> None:
        if self.found:
            i, s, pids = map(np.concatenate, zip(*self.found))
            order = np.lexsort((pids, -s, i))
            i, s, pids = i[order], s[order], pids[order]
            rank = np.arange(len(i)) - np.searchsorted(i, np.arange(len(self.q)))[i]
            self.floors[i[rank == self.k - 1]] = s[rank == self.k - 1]
            self.found, self.held = [(i[rank < self.k], s[rank < self.k], pids[rank < self.k])], int((rank < self.k).sum())

    def hits(self, part: int) -> Iterator[pa.RecordBatch]:
        self.cut()
        for i, s, pids in self.found:
            for at in range(0, len(i), 65_536):
                cut = slice(at, at + 65_536)
                names = [None if p == b"\xff" else p.decode() for p in pids[cut].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(self.qids[i[cut]].tolist(), pa.string()), pa.array(names, pa.string()), pa.array(s[cut]), pa.array([part] * len(names), pa.int32())], names=["qid", "pid", "score", "block"])


def best_of(queries: DataFrame, passages: DataFrame, groups: int, parts: int, k: int) -> DataFrame:
    """qid, pid, score, block: the k best of each group's queries in each part, from rows g, part, keys, x, single of both.

    Passages may have centre and radius, queries floors: then a block meets only queries whose floor its bound reaches.
    A task sees its queries first, then blocks one by one, and holds the best so far; so what it holds does not grow with
    the passages, and what it gives is k rows a query.
    """
    storage.small_batches(queries.sparkSession)
    form = ["g", "part", "keys", "x", "single", "floors", "centre", "radius"]
    full = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), *[F.col(c) if c in rows.columns else F.lit(None).cast("double" if c == "radius" else "array<double>").alias(c) for c in form])
    both = full(queries, 0).unionByName(full(passages, 1))
    dealt = both.repartitionById(groups * parts, F.col("g") * parts + F.col("part")).sortWithinPartitions("g", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, best = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if now != (row["g"], row["part"]):
                    if best:
                        yield from best.hits(now[1])
                    now, asked, best = (row["g"], row["part"]), [], None
                x = np.frombuffer(row["x"], "<f4" if row["single"] else "<f8").reshape(len(row["keys"]), -1).astype(np.float64)
                if row["kind"] == 0:
                    asked.append((row["keys"], x, row["floors"]))
                elif asked:
                    if best is None:
                        floors = None if asked[0][2] is None else np.concatenate([a[2] for a in asked])
                        best = Best([q for a in asked for q in a[0]], np.concatenate([a[1] for a in asked]), k, floors)
                    who = np.arange(len(best.q))
                    if row["centre"] is not None:
                        who = np.flatnonzero(best.q @ np.array(row["centre"]) + best.norms * row["radius"] >= best.floors - CLOSE)
                    best.meet(row["keys"], x, who)
        if best:
            yield from best.hits(now[1])

    return dealt.mapInArrow(run, HITS)


def topk(passages: DataFrame, queries: DataFrame, k: int, parts: int = 1) -> DataFrame:
    """qid, pid, score (6 places), rank: for each query (qid, vector) the k passages (pid, vector) of largest inner product.

    With `parts`, passages say in `block` which part (from 0) they are of, and the k best of each part come, with block.
    Passages are packed into blocks of rows that are sent to each group of queries (`best_of`), by a shuffle; no side is
    broadcast or gathered. Ties go to the smaller pid (as text).
    """
    storage.small_batches(passages.sparkSession)
    groups = group_count(queries)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = packed(passages, "pid", F.col("block") if parts > 1 else F.lit(0)).withColumn("g", each(groups))
    q = packed(queries, "qid", group_of("qid", groups)).withColumnRenamed("part", "g").withColumn("part", each(parts))
    hits = best_of(q, p, groups, parts, k)
    order = Window.partitionBy("qid", "block").orderBy(F.desc("score"), "pid")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked if parts > 1 else ranked.drop("block")


def merge_blocks(hits: DataFrame, k: int) -> DataFrame:
    """The k best of per-block hits (qid, block, pos, pid, score); ties: the earlier block, then the earlier place."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "block", "pos")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dedupe(hits: DataFrame, k: int) -> DataFrame:
    """Cut to k by (score, pid), then one row a (qid, pid) with its best score, ranked anew: fewer than k may stay."""
    cut = Window.partitionBy("qid").orderBy(F.desc("score"), "pid")
    kept = hits.withColumn("_r", F.row_number().over(cut)).filter(F.col("_r") <= k)
    once = kept.groupBy("qid", "pid").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(cut))


def mean_vectors(rows: DataFrame, key: str) -> DataFrame:
    """One vector a key: the unweighted mean of its vectors (all of one width), not made unit again.

    Vectors are summed up as they are, in each task before anything is shuffled. Null vectors do not count.
    """
    whole = rows.filter(F.col("vector").isNotNull()).select(key, array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    return whole.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("vector"))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1 (array of arrays, array of 0/1); null if none is."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] == 1)
    n = F.size(kept)
    total = F.aggregate(kept, F.transform(F.get(tokens, F.lit(0)), lambda v: F.lit(0.0)), lambda s, z: F.zip_with(s, z["t"], lambda a, b: a + b.cast("double")))
    return F.when(n > 0, F.transform(total, lambda v: v / n))


def encode(rows: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """`rows` with vector: `encoder` makes the model once a worker, which is then called with pieces of Arrow batches.

    A worker holds one batch and, of it, one piece as Python's strings; both have bounds, so the table's size does not matter.
    """

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encoder()
        for batch in batches:
            yield from encoded(model, batch)

    storage.small_batches(rows.sparkSession)
    return rows.withColumn("vector", run.asNondeterministic()(F.col(text).cast("string")))


def query_texts(turns: DataFrame, split: bool = False) -> DataFrame:
    """qid, text of rewrite records: the query, or with `split` a row for each of the rewrite's sub-queries.

    Vectors of one qid are to be averaged (`mean_vectors`). A rewrite that has no sub-query stays whole.
    """
    from larkspur.functions.text import split_rewrite

    rows = turns.select(F.coalesce("id", "sample_id").alias("qid"), F.coalesce("output", "rewrite_utt_text", "oracle_utt_text").alias("text")).filter("text is not null")
    if not split:
        return rows
    parts = split_rewrite(F.col("text"))
    return rows.select("qid", F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array("text"))).alias("text"))


def hash_encoder(width: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in model for `encode`: lower-case words add 1 at the place that their crc32 gives."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                out[row, zlib.crc32(word.encode()) % width] += 1
        return out

    return run


def hash_encode(text: Column, width: int = 8) -> Column:
    """A stand-in for an encoder: each token adds 1 at a place that its hash gives."""
    from larkspur.functions.text import tokenize

    places = F.transform(tokenize(text), lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % width).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
