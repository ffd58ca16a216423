"""Operator 11: periodic runs of words, by the runs theorem: Lyndon roots from the inverse suffix array, extended by LCP."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import read_table, small_batches

RUN = "struct<start:bigint,length:bigint,period:bigint>"
#: Texts go through the arrays together until they have so many words; a longer text goes alone.
GROUP_WORDS = 1 << 18


class SuffixIndex:
    """Inverse suffix array of several sequences at once, and LCP with a sparse table of its minima.

    `ids` holds the sequences one after the other, each closed by an end of its own. Numbers of one sequence stand above
    those of the one before, and its end is the smallest of them, so suffixes of different sequences share nothing and no
    shared prefix reaches an end.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        counts = np.bincount(ids)
        first = np.cumsum(counts) - counts
        rank = first[ids]  # the place of the first suffix that is equal so far
        levels, active, step = [rank.astype(np.int32)], np.flatnonzero(counts[ids] > 1), 1
        while len(active):
            key = (rank[active] << 32) | rank[active + step]
            order = np.argsort(key, kind="stable")
            key, active = key[order], active[order]
            old = key >> 32
            spot = np.arange(len(key))
            starts = lambda x: np.maximum.accumulate(np.where(np.diff(x, prepend=-1) != 0, spot, 0))
            own = starts(key)
            rank[active] = old + own - starts(old)
            lone = np.bincount(own, minlength=len(key))[own] == 1
            active, step = active[~lone], 2 * step
            levels.append(rank.astype(np.int32))
        self.inverse = rank
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)
        self.table = self._minima(self._lcp(levels))

    def _lcp(self, levels: list[np.ndarray]) -> np.ndarray:
        """Of each suffix (in order) with the one before: prefixes of 2^k words are equal if their ranks at level k are."""
        lcp = np.zeros(len(self.suffixes), np.int32)
        equal = [np.arange(1, len(self.suffixes))]
        for rank in levels:
            t = equal[-1]
            equal.append(t[rank[self.suffixes[t]] == rank[self.suffixes[t - 1]]])
        for k in range(len(levels) - 1, -1, -1):
            t = equal[k + 1]  # all that are equal over 2^k words; of those with more, 2^(k+1) are counted already
            a, b = self.suffixes[t] + lcp[t], self.suffixes[t - 1] + lcp[t]
            lcp[t] += (levels[k][a] == levels[k][b]).astype(np.int32) << k
        return lcp

    @staticmethod
    def _minima(lcp: np.ndarray) -> list[np.ndarray]:
        table = [lcp]
        while len(table[-1]) > 1 and table[-1].any():
            last, width = table[-1], 1 << (len(table) - 1)
            if len(last) <= width:
                break
            table.append(np.minimum(last[:-width], last[width:]))
        return table

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and at b (other ones) have in common."""
        x, y = self.inverse[a], self.inverse[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.table)):
            here = np.flatnonzero(k == level)
            row = self.table[level]
            out[here] = np.minimum(row[low[here]], row[high[here] - (1 << level) + 1])
        return out  # a range longer than the table's rows has a minimum of 0


def next_smaller(values: np.ndarray, reach: int = 8) -> np.ndarray:
    """For each place the next one with a smaller value, len(values) if there is none."""
    n = len(values)
    out = np.full(n, n, np.int64)
    left = np.arange(n)
    for step in range(1, reach + 1):
        left = left[left + step < n]
        found = values[left + step] < values[left]
        out[left[found]] = left[found] + step
        left = left[~found]
    table = [values]
    while 2 << (len(table) - 1) <= n:
        width = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
    at, own = left + reach + 1, values[left]
    for k in range(len(table) - 1, -1, -1):  # jump over stretches without a smaller value, longest first
        row = table[k]
        inside = at + (1 << k) <= n
        over = np.zeros(len(at), bool)
        over[inside] = row[at[inside]] > own[inside]
        at[over] += 1 << k
    out[left] = at
    return out


def find_runs(ids: np.ndarray, ends: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of at least `least` words and `exponent` periods, by start, then period.

    `ids` as in SuffixIndex, `ends` the places of the sequences' ends. By the runs theorem each run has, under one of the
    two orders, a Lyndon root that is the longest Lyndon word at its start; that word ends before the next smaller suffix.
    A run's first such root starts in the run's first period, so it must go on to the right for all but one period; roots
    that do not, and later roots, are left out.
    """
    index = SuffixIndex(ids)
    start = np.concatenate([[0], ends[:-1] + 1])
    found = []
    for order in (index.inverse, -index.inverse):  # the second order: ends are greatest, all else reversed
        i = np.arange(len(ids))
        j = next_smaller(order)
        end = np.repeat(ends, ends - start + 1)
        again = min(3, exponent - 1)  # so many words at least must come again: cheap before the table is asked
        near = (j + again <= end) & (i < end)
        i, j = i[near], j[near]
        for k in range(again):
            same = ids[i + k] == ids[j + k]
            i, j = i[same], j[same]
        p = j - i
        right = j + index.shared(i, j)
        far = right - i >= np.maximum(least, exponent * p) - p + 1
        i, j, p, right = i[far], j[far], p[far], right[far]
        room = i - start[np.searchsorted(ends, i)]
        low, high = np.zeros(len(i), np.int64), np.minimum(p, room)
        while (open_ := np.flatnonzero(low < high)).size:  # t words to the left are equal if those from there on are
            t = (low[open_] + high[open_] + 1) // 2
            fits = index.shared(i[open_] - t, j[open_] - t) >= t
            low[open_] = np.where(fits, t, low[open_])
            high[open_] = np.where(fits, high[open_], t - 1)
        whole = (low < p) & (right - i + low >= np.maximum(least, exponent * p))
        found.append(np.stack([i - low, right - i + low, p], 1)[whole])
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _group(words: list[list[bytes]], least: int, exponent: int) -> tuple[pa.Array, list[bytes]]:
    """Runs of each text, and each text without what its runs repeat."""
    parts, base = [], 0
    for own in words:
        numbers = {w: k for k, w in enumerate(dict.fromkeys(own))}
        got = np.fromiter(map(numbers.__getitem__, own), np.int64, len(own))
        parts += [got + (base + 1), [base]]
        base += 1 + len(numbers)
    ids = np.concatenate(parts)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    start, length, period = find_runs(ids, ends, least, exponent)
    owner = np.searchsorted(ends, start)
    offsets = np.searchsorted(owner, np.arange(len(words) + 1))
    first = ends - sizes
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, start + period, 1)
    np.add.at(mark, start + length, -1)
    dropped = np.cumsum(mark) > 0
    texts = []
    for k, own in enumerate(words):
        gone = dropped[first[k] : ends[k]]
        texts.append(b" ".join(own) if offsets[k] == offsets[k + 1] else b" ".join(w for w, g in zip(own, gone.tolist()) if not g))
    values = pa.StructArray.from_arrays([pa.array(start - first[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), texts


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period: words, by start, then period), collapsed, for every row of `docs`.

    A run is a maximal stretch of words with a smallest period of which it has at least `exponent`, and at least `least`
    words. collapsed is the text's words, joined by single spaces, without those that a run repeats after its first
    period. Words are runs of anything but ASCII white space. Each text is worked on alone and whole (nothing is
    shuffled), several together in one set of arrays. Null and empty texts have no words, no runs and '' as collapsed;
    repeated rows stay; further columns play no part; an empty table gives no rows.

    `rewrite` (doc_id, number of words) may give the numbers of the words to read instead, as many as there are.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                words, size, to = [], 0, at
                while to < batch.num_rows and (not words or size < GROUP_WORDS):
                    own = (batch.column(1)[to].as_py() or b"").split()  # of bytes: at ASCII white space only
                    if own and rewrite and (places := rewrite(batch.column(0)[to].as_py(), len(own))) is not None:
                        own = [own[k] for k in places.tolist()]
                    words.append(own)
                    size, to = size + len(own), to + 1
                runs, texts = _group(words, least, exponent)
                # bytes of the text, cut at single bytes below 0x80, are UTF-8 again
                collapsed = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([len(w) for w in words], pa.int64()), runs, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])
                at = to

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def repeated(doc_id: object, n: int) -> np.ndarray | None:
    """The contract's rewriting: in every tenth text, by a hash of its id, words from some place on repeat the first of them.

    Rows without doc_id stay as they are.
    """
    if doc_id is None or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def longest(runs: Column) -> Column:
    """The longest run; of several the first, then that of the smallest period; null without any."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all `documents` after the contract's rewriting, a row for each row; see `periodic_runs`.

    Null texts have no words; a null doc_id is a row as any other, whose text is not rewritten; repeated rows stay;
    further columns play no part; an empty table gives no rows.
    """
    found = periodic_runs(read_table(spark, sf_dir, "documents"), rewrite=repeated).withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_runs": op11_runs}
ORACLE_SQL: dict[str, str] = {}
