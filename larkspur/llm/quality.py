"""Operator 2: quality by the votes of nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import boxed, hash_bits, read_table, small_batches, unboxed

#: Hashed byte trigrams, then three terms of repetition.
TERMS, EXTRA = 4096, 3
#: Rows of a term matrix that are weighted at once.
BLOCK = 256


def terms(text: str | None) -> np.ndarray:
    """Term counts of a whole text: byte trigrams (in TERMS bins), then shares from 0 to 1 of words that repeat the word
    before, of words seen before, and of lines seen before."""
    out = np.zeros(TERMS + EXTRA, np.float32)
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) >= 3:
        code = raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35)
        out[:TERMS] = np.bincount((code * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=TERMS)
    words, lines = (text or "").split(), (text or "").split("\n")
    if words:
        out[TERMS] = sum(map(operator.eq, words, words[1:])) / len(words)
        out[TERMS + 1] = 1 - len(set(words)) / len(words)
        out[TERMS + 2] = 1 - len(set(lines)) / len(lines)
    return out


@dataclass
class Voters:
    """Labelled documents as unit vectors, with what takes a text to their space; bounded by the sample's parameter."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float
    keys: np.ndarray  # hashes of the voters' texts

    @staticmethod
    def weigh(counts: np.ndarray, idf: np.ndarray, own: bool = False) -> np.ndarray:
        """Rows of `counts` weighted and of length 1; with `own` they are changed where they stand, a block at a time."""
        z = counts if own else counts.copy()
        for at in range(0, len(z), BLOCK):
            part = z[at : at + BLOCK, :TERMS]
            np.log1p(part, out=part)
            part *= idf
            part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        return z

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, keys: np.ndarray, axes: int = 64, neighbours: int = 15, power: float = 8.0, rounds: int = 6, seed: int = 3, own: bool = False) -> Voters:
        """Truncated singular vectors of the weighted term matrix, by subspace iteration.

        The matrix is the only large thing here; with `own` it is made of `counts` itself, which then are no more.
        """
        seen = sum(((counts[at : at + BLOCK, :TERMS] > 0).sum(0) for at in range(0, len(counts), BLOCK)), np.zeros(TERMS, np.int64))
        idf = (np.log((len(counts) + 1) / (seen + 1)) + 0.1).astype(np.float32)
        z = cls.weigh(counts, idf, own)
        basis = np.random.default_rng(seed).standard_normal((z.shape[1], min(axes, *z.shape) if len(z) else 1)).astype(np.float32)
        for _ in range(rounds):
            basis = np.linalg.qr(z.T @ (z @ basis))[0] if len(z) else basis
        return cls(idf, basis, cls._unit(z @ basis), labels.astype(np.float64), neighbours, power, keys)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Similarity-weighted mean label of the nearest voters; the mean of all where nothing is similar, 0.5 without voters.

        Voters with the very text that is scored have no vote, so that no row's own label is an input of its score.
        """
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        prior = self.labels.mean()
        near = self._unit(self.weigh(counts, self.idf) @ self.axes) @ self.vectors.T
        near[keys[:, None] == self.keys[None, :]] = -1.0
        k = min(self.neighbours, near.shape[1])
        pick = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, pick, 1).astype(np.float64), 0) ** self.power
        total = weight.sum(1)
        votes = (weight * self.labels[pick]).sum(1) / np.maximum(total, 1e-300)
        return np.clip(np.where(total > 1e-12, votes, prior), 0.0, 1.0)


def text_key(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4096, **params) -> Voters:
    """Voters from labelled rows: `labels` (doc_id, quality), at most `sample` of them, those with the smallest hash of doc_id.

    The bound holds for whatever is gathered on the driver and broadcast: a row a doc_id. Null labels do not count; a
    doc_id that is labelled more than once has its mean label; if it has several rows, it votes with one of their texts,
    that of the smallest hash.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    known = known.orderBy(hash_bits(F.col("doc_id")), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(hash_bits(F.col("text")), "text")).alias("text"), F.min("quality").alias("quality"))

    def run(batches):
        for batch in batches:
            found = [terms(t.as_py()) for t in batch.column(1)]
            sparse = [(np.flatnonzero(x).astype("<u2").tobytes(), x[x != 0].tobytes()) for x in found]
            own = np.fromiter((text_key(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(own), pa.array([a for a, _ in sparse], pa.binary()), pa.array([b for _, b in sparse], pa.binary()), batch.column(2)], names=["doc_id", "key", "at", "n", "quality"])

    got = rows.mapInArrow(run, "doc_id string, key long, at binary, n binary, quality double").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["at"]), bytes(r["n"])))
    counts = np.zeros((len(got), TERMS + EXTRA), np.float32)
    for row, r in zip(counts, got):
        row[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], np.float32)
    quality, keys = np.array([r["quality"] for r in got]), np.array([r["key"] for r in got], np.int64).view(np.uint64)
    del got
    return Voters.fit(counts, quality, keys, own=True, **params)


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """All columns of `docs` (boxed or not) and _score: each whole text against all voters, in blocks; null texts are empty."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(voters)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            counts = np.stack([terms(t) for t in texts]) if texts else np.zeros((0, TERMS + EXTRA), np.float32)
            keys = np.fromiter(map(text_key, texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(counts, keys))], names=[*batch.schema.names, "_score"])

    schema = docs.limit(0).withColumn("_score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, **params) -> DataFrame:
    """The rows of `docs` that score `least` or more; null texts are scored as empty ones, repeated rows stay or go together."""
    return unboxed(score(boxed(docs), fit(docs, labels, **params)).filter(F.col("_score") >= least), docs.columns)


def held_out(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all `documents`, a row for each row, by labels outside the held-out fold.

    A score follows from the text alone: equal texts have equal scores, null and empty ones too (0.5 where nothing is
    labelled). A null doc_id counts as '' for the fold; further columns play no part; an empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    voters = fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out("doc_id")))
    out = score(docs, voters)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
ORACLE_SQL: dict[str, str] = {}
