"""Operator 13: whitening of embeddings by moments that partitions compute and a tree merges."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import materialise, read_table, small_batches

LONG = np.iinfo(np.int64)


@dataclass
class Moments:
    """Count, exact sums, mean and centred scatter of some vectors of one width."""

    n: int
    sums: np.ndarray  # Python's integers where vectors are integers
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        n = len(rows)
        exact = rows.dtype != np.int64 or (n * float(np.abs(rows.astype(np.float64)).max(initial=0)) < 2.0**62)
        sums = (rows if exact else rows.astype(object)).sum(0)
        x = rows.astype(np.float64)
        mean = x.mean(0)
        centred = x - mean
        rest = centred.mean(0)  # what rounding has left in the mean
        centred -= rest
        return cls(n, np.array([s.item() if isinstance(s, np.generic) else s for s in sums], object), mean + rest, centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        """The pairwise formula of Chan, Golub and LeVeque."""
        n = self.n + other.n
        delta = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * (other.n / n))
        return Moments(n, self.sums + other.sums, self.mean + delta * (other.n / n), scatter)

    @property
    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


def merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """Of each width apart."""
    return {w: a[w].merge(b[w]) if w in a and w in b else a.get(w) or b[w] for w in a.keys() | b.keys()}


def _rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: places and matrix of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    widths, values = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    out = {}
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        out[width] = (at, values[offsets[at][:, None] + np.arange(width)])
    return out


def moments(vectors: DataFrame, column: str) -> dict[int, Moments]:
    """Moments of an array column without nulls, by width: a state for each partition, merged in a tree.

    The tree's levels take at most about 16 states a task, the last one on the driver, so what it holds does not grow
    with the partitions.
    """

    def run(batches):
        state: dict[int, Moments] = {}
        for batch in batches:
            state = merged(state, {w: Moments.of(rows) for w, (_, rows) in _rows(batch.column(0)).items()})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    states = vectors.select(column).mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(r["state"]))
    parts = states.getNumPartitions()
    return states.treeReduce(merged, depth=max(2, math.ceil(math.log(max(parts, 2), 16)))) if parts else {}


def quantised(df: DataFrame, vector: str, scale: float, keep: list[str]) -> DataFrame:
    """`keep` and x, the long floor(scale * c) of each component c, for rows whose vector is whole.

    Null vectors and those that hold null, NaN or infinite components go. What does not fit a long becomes the nearest
    long.
    """
    small_batches(df.sparkSession, rows=8192)

    def run(batches):
        for batch in batches:
            column = batch.column(len(keep))
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            flat = column.flatten()  # null vectors have none
            sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            whole = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * values)
            cut = np.where(x >= 2.0**63, LONG.max, np.where(x < -(2.0**63), LONG.min, np.nan_to_num(np.where(np.abs(x) < 2.0**63, x, 0)).astype(np.int64)))
            inside = np.repeat(whole, sizes)
            offsets = np.concatenate([[0], np.cumsum(sizes[whole])])
            out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cut[inside], pa.int64()))
            kept = [batch.column(i).filter(pa.array(whole)) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, out], names=[*keep, "x"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(*keep, F.col(vector).cast("array<double>").alias("_vector")).mapInArrow(run, ", ".join([*kinds, "x array<bigint>"]))


@dataclass
class Whitening:
    """The projection to unit variance: rows of `axes` are unit eigenvectors, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None = None

    @classmethod
    def of(cls, found: Moments, components: int | None = None) -> Whitening:
        """Signs are such that an axis' largest entry (the first of several) is positive."""
        covariance = found.covariance
        values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        axes = axes[:, order].T
        largest = np.argmax(np.round(np.abs(axes), 9), axis=1) if axes.size else np.zeros(len(axes), int)
        axes = axes * np.where(axes[np.arange(len(axes)), largest] < 0, -1.0, 1.0)[:, None]
        return cls(found.n, found.sums, axes, np.maximum(values[order], 0.0), float(np.trace(covariance)))

    @property
    def usable(self) -> np.ndarray:
        """Components whose variance is more than what rounding leaves of none."""
        return self.values > 1e-12 * max(self.trace, 1e-300)

    def apply(self, rows: np.ndarray) -> np.ndarray:
        """Whitened rows, NaN in components without variance."""
        mean = np.array([s / self.n for s in self.sums])
        scale = np.where(self.usable, np.sqrt(np.where(self.usable, self.values, 1.0)), np.nan)
        return (rows.astype(np.float64) - mean) @ self.axes.T / scale

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
        most = max(self.n * float(np.abs(rows.astype(np.float64)).max(initial=0)), max((abs(s) for s in self.sums), default=0))
        if 4.0 * most * most * max(1, rows.shape[1]) < 2.0**62:
            far = self.n * rows - self.sums.astype(np.int64)
            return (far * far).sum(1).tolist()
        far = self.n * rows.astype(object) - self.sums
        return [v if v <= LONG.max else None for v in (far * far).sum(1)]


def fit(vectors: DataFrame, column: str = "x", components: int | None = None) -> tuple[Whitening, int] | None:
    """The whitening of an integer array column and its width: that of most vectors (of as many, the larger).

    A second pass over the same table applies it and measures how far the covariance of what comes out is from the
    identity. None if there is no vector of any width.
    """
    found = {w: m for w, m in moments(vectors, column).items() if w}
    if not found:
        return None
    width = max(found, key=lambda w: (found[w].n, w))
    white = Whitening.of(found[width], components)
    usable = np.flatnonzero(white.usable)
    if len(usable):
        sent = vectors.sparkSession.sparkContext.broadcast(white)

        def run(batches):
            for batch in batches:
                for w, (_, rows) in _rows(batch.column(0)).items():
                    if w == width:
                        out = sent.value.apply(rows)[:, usable]
                        yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(usable)).cast(pa.list_(pa.float64()))], names=["w"])

        after = moments(vectors.select(column).mapInArrow(run, "w array<double>"), "w")[len(usable)]
        white.error = float(np.abs(after.covariance - np.eye(len(usable))).max())
    return white, width


def whitened(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 4, scale: float = 256.0) -> DataFrame:
    """For every row with a whole vector and every component: `key`, component, n, deviation, whitened, explained, identity_error.

    Vectors are taken as longs floor(scale * c), each distinct one once in the fit; these are dealt by themselves in one
    shuffle, after copies were dropped in each partition, and kept as a table that both passes of the fit read. Moments
    of a partition are merged pairwise in a tree; only they come to the driver (width x width), and what is broadcast is
    `components` axes. Rows are then read once more and projected where they are.

    Rows with a vector that is null or holds null or non-finite components go, and so do those of another width than the
    most frequent among distinct vectors (of as many, the larger), empty vectors among them. A component without
    variance has whitened null; explained is null if there is no variance at all, identity_error (over the components
    with variance) if none has any; deviation is null where it does not fit a long. There are as many components as
    dimensions, if fewer. A null key is a key as any other, repeated rows stay, further columns play no part, and an
    empty table gives no rows.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = materialise(quantised(df, vector, scale, []).distinct(), "vectors")
    if (got := fit(distinct, "x", components)) is None:
        return spark.createDataFrame([], schema)
    white, width = got
    sent, dims = spark.sparkContext.broadcast(white), len(white.axes)

    def run(batches):
        white = sent.value
        explained = white.values / white.trace if white.trace > 0 else np.full(dims, np.nan)
        for batch in batches:
            for w, (at, rows) in _rows(batch.column(1)).items():
                if w != width:
                    continue
                m, out = len(rows), white.apply(rows)
                null = lambda values: pa.array(values, mask=np.isnan(values))
                columns = [
                    batch.column(0).take(pa.array(np.repeat(at, dims))),
                    pa.array(np.tile(np.arange(1, dims + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * dims, white.n, np.int64)),
                    pa.array(white.deviation(rows), pa.int64()).take(pa.array(np.repeat(np.arange(m), dims))),
                    null(out.ravel()),
                    null(np.tile(explained, m)),
                    null(np.full(m * dims, np.nan if white.error is None else white.error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return quantised(df, vector, scale, [key]).mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all whole vectors of `embeddings`; see `whitened`, odd rows included."""
    return whitened(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLE_SQL: dict[str, str] = {}
