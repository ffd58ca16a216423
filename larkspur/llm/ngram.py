"""Operator 8: an interpolated modified Kneser-Ney model, counted in Spark and stored as sorted hash arrays."""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import hash_bits, materialise, read_table, scratch_path, small_batches
from larkspur.llm.files import map_file, write_file

U8, U4 = np.dtype("<u8"), np.dtype("<u4")
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Tokens that a worker counts before it hands on what it has, and bytes of text that a model shard should stand for.
FLUSH, SHARD_BYTES = 2_000_000, 16_000_000
#: The vocabulary grows far slower than the corpus: it has at most 2 to this many shards.
VOCABULARY_BITS = 14
#: A context with this share of the training tokens is split over SALTS shards; one text in LAYOUT_SAMPLE tells which.
HOT_SHARE, SALTS, LAYOUT_SAMPLE = 1 / 1000, 64, 16
MOST_TASKS = 10_000


def _mix(a: np.ndarray, b) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (np.asarray(b, U8) + np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


@dataclass
class Tokens:
    """A batch of texts: hashes by code (0 is the start, 1 the end), codes with order - 1 starts before each text, the
    places of words and ends among them, and the number of these in each text."""

    hashes: np.ndarray
    line: np.ndarray
    places: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, order: int) -> Tokens:
        texts = pc.fill_null(texts.cast(pa.large_binary()).cast(pa.large_string(), safe=False), "")
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = words.flatten().dictionary_encode()
        kinds = coded.dictionary.cast(pa.large_binary()).to_pylist()
        hashes = np.concatenate([np.array([START, END], U8), np.fromiter((xxhash.xxh64_intdigest(w) for w in kinds), U8, len(kinds))])
        filled = np.fromiter(map(len, kinds), np.int64, len(kinds)) > 0
        at = coded.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
        keep = filled[at] if len(kinds) else np.zeros(0, bool)
        at, owner = at[keep], owner[keep]
        counts = np.bincount(owner, minlength=len(texts))
        pad = order - 1
        begin = np.concatenate([[0], np.cumsum(counts + pad + 1)])[:-1]
        line = np.zeros(int((counts + pad + 1).sum()), np.int32)
        rank = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        line[begin[owner] + pad + rank] = at + 2
        line[begin + pad + counts] = 1
        return cls(hashes, line, np.flatnonzero(line), counts + 1)


def _sorted(columns: list[np.ndarray], kinds: int, weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of code columns (codes below `kinds`), in their order, and the sum of weights (or number) of each."""
    key, size = columns[0].astype(np.int64), kinds
    for column in columns[1:]:
        if size * kinds >= 1 << 63:
            kept, key = np.unique(key, return_inverse=True)
            size = len(kept)
        key, size = key * kinds + column, size * kinds
    order = np.argsort(key, kind="stable" if weights is not None else None)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(key))) if weights is None else np.add.reduceat(weights[order], first) if len(key) else weights
    return [c[order[first]] for c in columns], sums


def _contexts(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of the words before the last, from the nearest to the farthest."""
    out = np.zeros(len(columns[-1]), U8)
    for c in columns[-2::-1]:
        out = _mix(out, c.astype(U8))
    return out


# --- bodies: entries on their way between tasks; arrays of small numbers, larger ones apart ---


def _small(values: np.ndarray) -> list[bytes]:
    """One byte a number, 255 for those apart."""
    far = np.flatnonzero(values >= 255)
    return [np.array([len(far)], "<i8").tobytes(), np.minimum(values, 255).astype(np.uint8).tobytes(), far.astype(U4).tobytes(), values[far].astype("<i8").tobytes()]


class _Reader:
    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def take(self, kind, n: int) -> np.ndarray:
        kind = np.dtype(kind)
        out = np.frombuffer(self.raw, kind, n, self.at) if n else np.zeros(0, kind)
        self.at += n * kind.itemsize
        return out

    def small(self, n: int) -> np.ndarray:
        far = int(self.take("<i8", 1)[0])
        out = self.take(np.uint8, n).astype(np.int64)
        spots = self.take(U4, far)
        out[spots] = self.take("<i8", far)
        return out


def _code_type(kinds: int) -> np.dtype:
    return np.dtype(np.uint8 if kinds <= 1 << 8 else "<u2" if kinds <= 1 << 16 else "<u4")


_CODEC = "zstd"


def _pack(columns: list[np.ndarray], sums: np.ndarray) -> tuple[int, bytes]:
    """Entries as compressed bytes, with their size: of each column the bytes of like weight together, as many as it needs."""
    parts = [np.array([len(sums)], "<i8").tobytes()]
    for c in columns:
        width = max(1, -(-int(c.max(initial=0)).bit_length() // 8))
        parts += [bytes([width]), c.astype(U8).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    raw = b"".join([*parts, *_small(sums)])
    return len(raw), pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpack(bodies: list[tuple[int, bytes]], width: int, kind=np.int64) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns and sums of several bodies together."""
    found = []
    for size, body in bodies:
        read = _Reader(pa.decompress(body, decompressed_size=size, codec=_CODEC))
        n, columns = int(read.take("<i8", 1)[0]), []
        for _ in range(width):
            used = int(read.take(np.uint8, 1)[0])
            whole = np.zeros((n, 8), np.uint8)
            whole[:, :used] = read.take(np.uint8, n * used).reshape(used, n).T
            columns.append(whole.view(U8)[:, 0].astype(kind))
        found.append((columns, read.small(n)))
    return [np.concatenate([c[i] for c, _ in found]) for i in range(width)], np.concatenate([s for _, s in found])


@dataclass
class Vocabulary:
    """The training words: sorted hashes in shards by leading bits, each with how often it occurs; a word's id is its rank
    among all hashes. The start's id is the number of words, unknown words all have the next one."""

    folder: str
    bits: int
    offsets: np.ndarray  # ids at which shards begin, then the number of words
    tokens: int

    def __len__(self) -> int:
        return int(self.offsets[-1])

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids, and how often each word occurs."""
        ids, raw = np.full(len(hashes), len(self) + 1, np.int64), np.zeros(len(hashes), np.int64)
        for shard, pick in _by_shard(_leading(hashes, self.bits), self.bits):
            table = _mapped_words(f"{self.folder}/words-{shard}")
            if table is not None:
                spot = np.minimum(np.searchsorted(table[0], hashes[pick]), len(table[0]) - 1)
                hit = table[0][spot] == hashes[pick]
                ids[pick[hit]] = self.offsets[shard] + spot[hit]
                raw[pick[hit]] = _numbers(table[1:], spot[hit])
        ids[hashes == START] = len(self)
        return ids, raw


def _leading(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(hashes), np.int32)


def _numbers(small: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Numbers out of what `_small` wrote."""
    low, spots, far = small
    out = low[at].astype(np.int64)
    big = out == 255
    if big.any():
        out[big] = far[np.searchsorted(spots, at[big])]
    return out


@functools.lru_cache(maxsize=16_384)
def _mapped_words(uri: str):
    """Hashes (none in files of counts alone) and numbers of a file."""
    raw = map_file(uri)
    if raw is None or not len(raw):
        return None
    read = _Reader(raw)
    n, keys = read.take("<i8", 2).tolist()
    hashes = read.take(U8, n * keys)
    far = int(read.take("<i8", 1)[0])
    return hashes, read.take(np.uint8, n), read.take(U4, far), read.take("<i8", far)


@dataclass
class Layout:
    """How entries are dealt to shards, the same for counting and for look-up; words are ids."""

    order: int
    bits: int
    hot: list[np.ndarray]  # sorted hot contexts, by context length - 1

    def shard(self, k: int, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """By the context's hash, salted by the word if the context is hot."""
        hot = self.hot[k - 2]
        if len(hot):
            spot = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
            contexts = np.where(hot[spot] == contexts, _mix(contexts, _mix(words.astype(U8), 1) >> np.uint64(58)), contexts)
        return _leading(contexts, self.bits)


def _by_shard(shards: np.ndarray, bits: int):
    """(shard, rows) for each shard that occurs."""
    order = np.argsort(shards.astype(np.uint16) if bits <= 16 else shards, kind="stable")
    edges = np.flatnonzero(np.diff(shards[order], prepend=-1, append=-2)) if len(order) else []
    for lo, hi in zip(edges, edges[1:]):
        yield int(shards[order[lo]]), order[lo:hi]


#: k: order of the body's entries, or -1 for statistics.
ENTRIES = "shard int, k int, size long, body binary, stats array<long>"
_FIELDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _FIELDS)], names=["shard", "k", "size", "body", "stats"])


def _flushed(order: int, flush):
    """Calls `flush` with the tokens of FLUSH or more words of a task's batches, again and again."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(Tokens.of(batch.column(0), order))
            size += len(held[-1].places)
            if size >= FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _union(held: list[Tokens]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct hashes of several batches, sorted, and of each batch the places of its own among them."""
    hashes, codes = np.unique(np.concatenate([t.hashes for t in held]), return_inverse=True)
    return hashes, np.split(codes.astype(np.int32), np.cumsum([len(t.hashes) for t in held])[:-1])


def _count_words(bits: int):
    """Texts to words with how often they occur."""

    def flush(held: list[Tokens]):
        hashes, codes = _union(held)
        n = sum(np.bincount(c[t.line[t.places]], minlength=len(hashes)) for c, t in zip(codes, held))
        hashes, n = hashes[n > 0], n[n > 0]
        for shard, pick in _by_shard(_leading(hashes, bits), bits):
            yield _row(shard, 1, *_pack([hashes[pick]], n[pick]), None)

    return _flushed(1, flush)


def _write_words(folder: str):
    def finish(shard: int, bodies: dict[int, list], tell):
        (hashes,), counts = _unpack(bodies[1], 1, U8)
        hashes, at = np.unique(hashes, return_inverse=True)
        counts = np.bincount(at, counts, len(hashes)).astype(np.int64)
        write_file(f"{folder}/words-{shard}", b"".join([np.array([len(hashes), 1], "<i8").tobytes(), hashes.tobytes(), *_small(counts)]))
        tell(0, shard, [len(hashes), int(counts.sum()), 0, 0, 0, 0])
        return ()

    return _each_shard(finish)


def _rows(layout: Layout, vocabulary: Vocabulary, k: int, columns: list[np.ndarray], sums: np.ndarray):
    if k == 1:
        shards, bits = (np.searchsorted(vocabulary.offsets[1:], columns[0], side="right")).astype(np.int32), vocabulary.bits
    else:
        shards, bits = layout.shard(k, _contexts(columns), columns[-1]), layout.bits
    for shard, pick in _by_shard(shards, bits):
        yield _row(shard, k, *_pack([c[pick] for c in columns], sums[pick]), None)


def _count(layout: Layout, vocabulary: Vocabulary):
    """Texts to entries of the highest order, combined over FLUSH tokens."""

    def flush(held: list[Tokens]):
        hashes, codes = _union(held)
        columns = [np.concatenate([c[t.line[t.places - back]] for c, t in zip(codes, held)]) for back in range(layout.order - 1, -1, -1)]
        columns, sums = _sorted(columns, len(hashes))
        ids = vocabulary.look_up(hashes)[0]
        yield from _rows(layout, vocabulary, layout.order, [ids[c] for c in columns], sums)

    return _flushed(layout.order, flush)


def _each_shard(finish):
    """Runs `finish(shard, bodies by k, tell)` on each shard's rows, which stand together, and adds up what a task is told."""

    def run(batches):
        stats: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0] * 6)

        def tell(order: int, context: int, values: list[int]) -> None:
            stats[order, context] = [a + b for a, b in zip(stats[order, context], values)]

        now, bodies = None, defaultdict(list)
        for batch in batches:
            for shard, kind, size, body, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                if kind < 0:
                    order, context, *values = told.as_py()
                    tell(order, context, values)
                    continue
                if shard != now and bodies:
                    yield from finish(now, bodies, tell)
                    bodies = defaultdict(list)
                now = shard
                bodies[kind].append((size, body.as_py()))
        if bodies:
            yield from finish(now, bodies, tell)
        for (order, context), values in stats.items():
            yield _row(now or 0, -1, None, None, [order, context, *values])

    return run


def _reduce(layout: Layout, vocabulary: Vocabulary, k: int, folder: str):
    """Entries of order k, shard by shard: writes the shard's arrays, hands on entries of order k - 1 and statistics.

    Statistics are (order, context or 0, six numbers): counts of counts 1 to 4, entries and sum of an order, or sum and
    entries of a hot context's part.
    """

    def finish(shard: int, bodies: dict[int, list], tell):
        columns, counts = _unpack(bodies[k], k)
        columns, counts = _sorted(columns, len(vocabulary) + 2, counts)
        tell(k, 0, [*(int((counts == c).sum()) for c in range(1, 5)), len(counts), int(counts.sum())])
        if k == 1:
            first = int(vocabulary.offsets[shard])
            whole = np.zeros(int(vocabulary.offsets[shard + 1]) - first, np.int64)
            whole[columns[0] - first] = counts
            write_file(f"{folder}/1-{shard}", b"".join([np.array([len(whole), 0], "<i8").tobytes(), *_small(whole)]))
            return
        contexts = _contexts(columns)
        first = np.flatnonzero(np.any([np.diff(c, prepend=-1) != 0 for c in columns[:-1]], axis=0))
        sums = [np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        hot = np.isin(contexts[first], layout.hot[k - 2])
        for i in np.flatnonzero(hot):
            tell(k, int(contexts[first][i].view(np.int64)), [*(int(s[i]) for s in sums), 0, 0])
        write_file(f"{folder}/{k}-{shard}", _table(_mix(contexts, columns[-1].astype(U8)), counts[:, None]))
        write_file(f"{folder}/{k}-{shard}-contexts", _table(contexts[first][~hot] << np.uint64(layout.bits), np.stack(sums, 1)[~hot]))
        yield from _rows(layout, vocabulary, k - 1, *_sorted(columns[1:], len(vocabulary) + 2))

    return _each_shard(finish)


# --- files: sorted hash arrays ---


def _table(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Keys (u8) with a row of numbers each: the leading bits of a key are its bucket (about 16 keys have one), the next 32
    stand sorted in it; different rows of numbers stand once, in the order of their first key."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    bits = max(0, math.ceil(math.log2(max(1, len(keys) / 16))))
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    offsets = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    alike = np.zeros(len(keys), U8)
    for i in range(values.shape[1]):
        alike = _mix(alike, values[:, i].astype(U8))
    _, place, ids = np.unique(alike, return_index=True, return_inverse=True)
    head = np.array([len(keys), bits, int(np.diff(offsets).max(initial=0)), len(place), values.shape[1]], "<i8")
    return b"".join([head.tobytes(), values[place].astype("<i8").tobytes(), offsets.astype(U4).tobytes(), ((keys << np.uint64(bits)) >> np.uint64(32)).astype(U4).tobytes(), ids.astype(_code_type(len(place))).tobytes()])


@functools.lru_cache(maxsize=16_384)
def _mapped(uri: str):
    raw = map_file(uri)
    if raw is None or not len(raw):
        return None
    read = _Reader(raw)
    n, bits, most, kinds, width = read.take("<i8", 5).tolist()
    return bits, most, read.take("<i8", kinds * width).reshape(kinds, width), read.take(U4, (1 << bits) + 1), read.take(U4, n), read.take(_code_type(kinds), n)


def _find(uri: str, keys: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
    """Puts the numbers of `keys` into `rows` of `out`: one binary search in each key's bucket, all keys at once."""
    table = _mapped(uri)
    if table is None or not len(table[4]):
        return
    bits, most, values, offsets, have, ids = table
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    wanted = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(U4)
    low, high = offsets[bucket].astype(np.int64), offsets[bucket + 1].astype(np.int64)
    end, last = high, len(have) - 1
    for _ in range(int(most).bit_length()):
        middle = (low + high) >> 1
        right = (have[np.minimum(middle, last)] < wanted) & (middle < high)
        low, high = np.where(right, middle + 1, low), np.where(right, high, middle)
    spot = np.minimum(low, last)
    hit = (low < end) & (have[spot] == wanted)
    out[rows[hit]] = values[ids[spot[hit]]]


@dataclass
class Model:
    """What look-up needs besides the arrays in `folder`; as large for any corpus (hot contexts are at most some thousand)."""

    folder: str
    layout: Layout
    discounts: list[list[float]]  # by order - 1: for counts 0, 1, 2, 3 and more
    totals: list[list[int]]  # by order - 1: sum of counts, entries with count 1, 2, 3 and more
    vocabulary: Vocabulary
    hot: list[np.ndarray]  # by context length - 1: of the layout's hot contexts, sum and entries with count 1, 2, 3 and more


def _through(rows: DataFrame, shards: int, step) -> DataFrame:
    tasks = min(shards, MOST_TASKS)
    return rows.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard").mapInArrow(step, ENTRIES)


def _told(rows: DataFrame) -> dict[tuple[int, int], list[int]]:
    """Statistics of all tasks, added up by Spark."""
    told = rows.filter("k < 0").groupBy(F.get("stats", F.lit(0)).alias("order"), F.get("stats", F.lit(1)).alias("context"))
    return {(r["order"], r["context"]): [r[f"s{i}"] for i in range(6)] for r in told.agg(*[F.sum(F.get("stats", F.lit(2 + i))).alias(f"s{i}") for i in range(6)]).collect()}


def vocabulary(texts: DataFrame, bits: int, folder: str) -> Vocabulary:
    """Counts the words of whole texts into `folder`. Driver: one row a shard, at most 2 ** VOCABULARY_BITS of them."""
    bits = min(bits, VOCABULARY_BITS)
    told = _told(_through(texts.mapInArrow(_count_words(bits), ENTRIES), 1 << bits, _write_words(folder)))
    sizes = [told.get((0, i), [0])[0] for i in range(1 << bits)]
    return Vocabulary(folder, bits, np.cumsum([0, *sizes]), sum(v[1] for v in told.values()))


def train(texts: DataFrame, order: int = 3) -> Model:
    """A model of the whole texts (one column, null as empty) of the given order (2 or more), in files of the shared folder.

    First the words are counted; n-grams are rows of word ids from then on. Workers count n-grams and combine equal ones
    before they are dealt to shards; each shard is sorted and written by one task, which hands on the entries of the next
    lower order, whose count is the number of different words before them. Shards stand for about SHARD_BYTES of text
    whatever the corpus; contexts with HOT_SHARE of the tokens are dealt over SALTS shards. Which ones is told by one text
    in LAYOUT_SAMPLE: that decides where entries go, not what they are, and all counts and statistics are those of all
    texts. Discounts come from the counts of counts of all shards.
    """
    spark = texts.sparkSession
    small_batches(spark)
    texts = texts.select(F.col(texts.columns[0]).cast("string").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = math.ceil(math.log2(max(1, size / SHARD_BYTES)))
    folder = scratch_path(spark, "ngrams")
    words = vocabulary(texts, bits, folder)

    def heavy(batches):
        found: dict[tuple[int, int], int] = {}
        total = 0
        for batch in batches:
            t = Tokens.of(batch.column(0), order)
            total += len(t.places)
            ids, context = words.look_up(t.hashes)[0].astype(U8), np.zeros(len(t.places), U8)
            for k in range(order - 1):
                context = _mix(context, ids[t.line[t.places - k - 1]])
                kinds, n = np.unique(context, return_counts=True)
                often = n > max(8, len(t.places) * HOT_SHARE / 2)
                for c, m in zip(kinds[often].view(np.int64).tolist(), n[often].tolist()):
                    found[k, c] = found.get((k, c), 0) + m
        rows = [(-1, 0, total), *((k, c, m) for (k, c), m in found.items() if m > total * HOT_SHARE / 4)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["k", "context", "n"])

    sample = texts.filter(hash_bits(F.monotonically_increasing_id(), F.lit("layout")) % LAYOUT_SAMPLE == 0)
    seen = materialise(sample.mapInArrow(heavy, "k int, context long, n long").groupBy("k", "context").agg(F.sum("n").alias("n")), "heavy")
    own = seen.filter("k < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = seen.filter((F.col("k") >= 0) & (F.col("n") > own * HOT_SHARE)).collect()
    layout = Layout(order, bits, [np.sort(np.array([r["context"] for r in often if r["k"] == k], np.int64).view(U8)) for k in range(order - 1)])
    rows = texts.mapInArrow(_count(layout, words), ENTRIES)
    for k in range(order, 0, -1):
        rows = _through(rows, 1 << (bits if k > 1 else words.bits), _reduce(layout, words, k, folder))
    return _model(folder, layout, words, _told(rows))


def _model(folder: str, layout: Layout, words: Vocabulary, told: dict[tuple[int, int], list[int]]) -> Model:
    discounts, totals, hot = [], [], []
    for k in range(1, layout.order + 1):
        n1, n2, n3, n4, entries, adjusted = told.get((k, 0), [0] * 6)
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ds = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        discounts.append([0.0, *(min(max(d, 0.1), c - 0.05) for c, d in enumerate(ds, 1))])
        totals.append([adjusted, n1, n2, entries - n1 - n2])
        if k > 1:
            hot.append(np.array([told.get((k, c), [0] * 6)[:4] for c in layout.hot[k - 2].view(np.int64).tolist()], np.int64).reshape(-1, 4))
    return Model(folder, layout, discounts, totals, words, hot)


def _before(model: Model, ids: np.ndarray) -> np.ndarray:
    """How many different words stand before each word in training."""
    out, offsets = np.zeros(len(ids), np.int64), model.vocabulary.offsets
    known = np.flatnonzero(ids < len(model.vocabulary))
    for shard, pick in _by_shard(np.searchsorted(offsets[1:], ids[known], side="right").astype(np.int32), model.vocabulary.bits):
        table = _mapped_words(f"{model.folder}/1-{shard}")
        if table is not None:
            out[known[pick]] = _numbers(table[1:], ids[known[pick]] - offsets[shard])
    return out


def _context_sums(model: Model, k: int, contexts: np.ndarray) -> np.ndarray:
    """sum, entries with count 1, 2, 3 and more of contexts of k - 1 words."""
    out = np.zeros((len(contexts), 4), np.int64)
    for shard, pick in _by_shard(_leading(contexts, model.layout.bits), model.layout.bits):
        _find(f"{model.folder}/{k}-{shard}-contexts", contexts[pick] << np.uint64(model.layout.bits), out, pick)
    hot = model.layout.hot[k - 2]
    if len(hot):
        spot = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
        own = hot[spot] == contexts
        out[own] = model.hot[k - 2][spot[own]]
    return out


def log_probabilities(model: Model, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability by the model, and how often the token occurs in training."""
    words = t.line[t.places]
    ids, raw = model.vocabulary.look_up(t.hashes)
    before = _before(model, ids)
    total, *kept = model.totals[0]
    discount = lambda k, c: np.array(model.discounts[k - 1])[np.minimum(c, 3)]
    if total:
        p = (before - discount(1, before)) / total + sum(d * m for d, m in zip(model.discounts[0][1:], kept)) / total / (len(model.vocabulary) + 1)
    else:
        p = np.ones(len(t.hashes))
    p, raw, ids = p[words], raw[words], ids.astype(U8)
    context, ends = np.zeros(len(words), U8), ids[words]
    for k in range(2, model.layout.order + 1):
        back = t.line[t.places - k + 1]
        context = _mix(context, ids[back])
        count, pairs = np.zeros((len(words), 1), np.int64), _mix(context, ends)
        for shard, pick in _by_shard(model.layout.shard(k, context, ends), model.layout.bits):
            _find(f"{model.folder}/{k}-{shard}", pairs[pick], count, pick)
        count = count[:, 0]
        sums = _context_sums(model, k, context) if k > 2 else _context_sums(model, 2, _mix(np.zeros(len(ids), U8), ids))[back]
        known = sums[:, 0] > 0
        safe = np.where(known, sums[:, 0], 1)
        p = np.where(known, (count - discount(k, count)) / safe + sums[:, 1:] @ np.array(model.discounts[k - 1][1:]) / safe * p, p)
    return np.log10(p), raw


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row (whole texts, null as empty); repeated rows stay."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    n, v = model.vocabulary.tokens, len(model.vocabulary)

    def run(batches):
        for batch in batches:
            t = Tokens.of(batch.column(1), model.layout.order)
            first = np.cumsum(t.counts) - t.counts
            logs, raw = log_probabilities(model, t)
            base = np.log10((raw + 0.5) / (n + 0.5 * (v + 1)))
            add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t.counts.astype(np.int64)), pa.array(add((raw > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(logs))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def fold(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def op8_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents` by a model of order 3 of those whose fold is not 1, a row for each row.

    Null and empty texts have one token, the end; a null doc_id counts as '' for the fold; repeated rows count and are
    scored as often as they are there; further columns play no part; an empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.filter(fold("doc_id") != 1).select("text"))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op8_ngram": op8_ngram}
ORACLE_SQL: dict[str, str] = {}
