"""Operator 9: best-fit packing by linear grouping, planned on the histogram of lengths."""

from __future__ import annotations

import bisect
import functools
import json
import re
import warnings
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import materialise, read_table, running, small_batches

CAPACITY = 2048


class Encoder:
    """A tokenizers file applied to whole texts.

    A byte-level BPE whose ids stand in the order of its merges is run by its ranks, which gives the same ids several
    times faster; other files, and texts that hold an added token or very long white space, go through the tokenizer
    itself.
    """

    #: The split of byte-level BPE; a fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.added = [t["content"] for t in made.get("added_tokens") or []]
        pre, model = made.get("pre_tokenizer") or {}, made["model"]
        vocab, merges = model["vocab"], model.get("merges") or []
        joined = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
        usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.ranks = None
        if usual and model["type"] == "BPE" and not made.get("normalizer") and None not in joined and joined == sorted(joined):
            back = {c: b for b, c in self._letters().items()}
            ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in self.added}
            self.ranks = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _letters() -> dict[int, str]:
        """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = (b for b in range(256) if b not in plain)
        return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}

    #: Characters of white space in a row beyond which the ranks' expressions give up.
    BLANKS = 100_000

    def _plain(self, text: str) -> bool:
        if self.ranks is None or any(t in text for t in self.added):
            return False
        return len(text) <= self.BLANKS or all(m.end() - m.start() <= self.BLANKS for m in re.finditer(r"\s+", text))

    def __call__(self, text: str) -> list[int]:
        if not self._plain(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for): every document's ids and the end id, cut if too long.

    All pieces of a longer document have `capacity` ids, but the first, which has what is left over. Null texts are
    empty: their one piece is the end id alone. Repeated rows are documents of their own.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            rows, parts = [], []
            for i, text in enumerate(batch.column(1)):
                got = np.array([*encode(text.as_py() or ""), end], dtype="<u4")
                cuts = [0, *range(len(got) % capacity or capacity, len(got), capacity), len(got)]
                for piece, (at, to) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((i, piece, at, to - at, zlib.crc32(got[at:to])))
                    if ids:
                        parts.append(got[at:to].astype(np.int32))
            owner, *rest = (pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5))
            cols = [batch.column(0).take(owner), rest[0].cast(pa.int32()), *rest[1:], *([pa.array(parts, pa.list_(pa.int32()))] if ids else [])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


# --- the plan: from a histogram of lengths to runs of equally filled sequences ---


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths, longest first, cut into `groups` groups of equally many pieces: (rounded-up size, [(length, pieces)])."""
    total = sum(counts.values())
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = -(-total // groups)
            n = min(left, room)
            out[-1][1].append((length, n))
            left, room = left - n, room - n
    return out


def _price(sizes: list[int], values: np.ndarray, most: list[int], capacity: int) -> tuple[float, dict[int, int]]:
    """The most valuable way to fill one sequence (bounded knapsack, by size)."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(sizes), capacity + 1), dtype=np.int16)
    for i, size in enumerate(sizes):
        base = best
        best = base.copy()
        for k in range(1, min(most[i], capacity // size) + 1):
            with_k = base[: capacity + 1 - k * size] + k * values[i]
            better = with_k > best[k * size :] + 1e-12
            best[k * size :][better] = with_k[better]
            took[i, k * size :][better] = k
    at, out = int(best.argmax()), {}
    for i in range(len(sizes) - 1, -1, -1):
        if k := int(took[i, at]):
            out[i] = k
            at -= k * sizes[i]
    return float(best.max()), out


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Fillings (size index -> times) and how often to use each; together they hold exactly `need` of each size.

    Solves the configuration programme (fewest fillings that cover the need) by the simplex method with columns generated
    by `_price`, cuts the uses down to whole numbers and fills what is left by the fullest filling that it allows. If
    `rounds` do not suffice the fillings found so far are used, and a warning says how far from the least they may be.
    """
    m, left, out = len(sizes), list(need), Counter()
    if m:
        columns = [{i: capacity // s} for i, s in enumerate(sizes)]
        inverse = np.diag([1.0 / c[i] for i, c in enumerate(columns)])
        for _ in range(rounds):
            value, fill = _price(sizes, np.maximum(inverse.sum(axis=0), 0.0), [capacity // s for s in sizes], capacity)
            if value <= 1 + 1e-7:
                break
            column = np.zeros(m)
            column[list(fill)] = list(fill.values())
            step, now = inverse @ column, inverse @ np.array(need, dtype=float)
            ratio = np.where(step > 1e-9, now / np.where(step > 1e-9, step, 1.0), np.inf)
            r = int(ratio.argmin())
            if not np.isfinite(ratio[r]):
                break
            inverse[r] /= step[r]
            others = np.arange(m) != r
            inverse[others] -= np.outer(step[others], inverse[r])
            columns[r] = fill
        else:
            value, _ = _price(sizes, np.maximum(inverse.sum(axis=0), 0.0), [capacity // s for s in sizes], capacity)
            if value > 1 + 1e-7:
                warnings.warn(f"packing: {rounds} rounds did not reach the least number of fillings; up to {value - 1:.2%} above", stacklevel=2)
        for fill, uses in zip(columns, inverse @ np.array(need, dtype=float)):
            times = min([int(uses + 1e-6), *(left[i] // k for i, k in fill.items())])
            if times > 0:
                out[tuple(sorted(fill.items()))] += times
                for i, k in fill.items():
                    left[i] -= k * times
    while any(left):
        _, fill = _price(sizes, np.array(sizes, dtype=float) ** 1.0001, left, capacity)
        times = max(1, min(left[i] // k for i, k in fill.items()))
        for i, k in fill.items():
            left[i] -= k * times
        out[tuple(sorted(fill.items()))] += times
    return [(dict(f), n) for f, n in out.items()]


class Plan:
    """Which sequence and place each piece of a histogram gets, as intervals of its rank among pieces of equal length.

    Runs of `count` sequences with like contents are kept together: an entry (length, first, count, times, sequence,
    offset) puts the pieces of that length with ranks from `first` on into those sequences, `times` in each.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 160, small: int | None = None):
        self.capacity, self.entries, self.sequences = capacity, [], 0
        self.used = defaultdict(int)  # ranks given, by length
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, count)
        self.rooms: list[int] = []
        small = capacity // 5 if small is None else small
        counts = {k: n for k, n in histogram.items() if n}
        if full := counts.pop(capacity, 0):
            self._put(self._open(full), full, 0, capacity, 1)
        large = linear_groups({k: n for k, n in counts.items() if k > small}, groups)
        need = [sum(n for _, n in items) for _, items in large]
        stock = [[list(x) for x in items] for _, items in large]
        for fill, times in configurations([size for size, _ in large], need, capacity):
            self._substitute([(stock[i], k) for i, k in sorted(fill.items())], times)
        for length in sorted((k for k in counts if k <= small), reverse=True):
            self._best_fit(length, counts[length])

    def _open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _put(self, sequence: int, count: int, offset: int, length: int, times: int) -> None:
        self.entries.append((length, self.used[length], count, times, sequence, offset))
        self.used[length] += count * times

    def _substitute(self, slots: list[tuple[list[list[int]], int]], times: int) -> None:
        """Takes `times` fillings' pieces out of the groups' stocks, real lengths for rounded ones, run by run."""
        queues = []
        for stock, k in slots:
            for _ in range(k):
                queue, want = [], times
                while want:
                    n = min(want, stock[0][1])
                    queue.append([stock[0][0], n])
                    stock[0][1] -= n
                    want -= n
                    if not stock[0][1]:
                        stock.pop(0)
                queues.append(queue)
        while times:
            count = min(q[0][1] for q in queues)
            first, offset = self._open(count), 0
            for q in queues:
                self._put(first, count, offset, q[0][0], 1)
                offset += q[0][0]
                q[0][1] -= count
                if not q[0][1]:
                    q.pop(0)
            self._gap(self.capacity - offset, first, count)
            times -= count

    def _gap(self, room: int, first: int, count: int) -> None:
        if room and count:
            if room not in self.gaps:
                bisect.insort(self.rooms, room)
            self.gaps[room].append((first, count))

    def _best_fit(self, length: int, n: int) -> None:
        """Each piece goes where least room is left; one sequence after the other is filled with the same length."""
        while n:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                self._gap(self.capacity, self._open(k := -(-n // (self.capacity // length))), k)
                continue
            room = self.rooms[at]
            first, count = self.gaps[room].pop()
            if not self.gaps[room]:
                del self.gaps[room], self.rooms[at]
            times = room // length
            if n >= times:
                took = min(count, n // times)
            else:
                took, times = 1, n
            self._put(first, took, self.capacity - room, length, times)
            self._gap(room - times * length, first, took)
            self._gap(room, first + took, count - took)
            n -= took * times


def pack(parts: DataFrame, capacity: int = CAPACITY, groups: int = 160) -> DataFrame:
    """`parts` (a materialised table of pieces with doc_id, piece, start, length) with sequence_id and offset.

    Linear grouping: lengths over a fifth of the capacity are cut into `groups` groups of equally many pieces, longest
    first, and rounded up to the group's longest; the configuration programme over these few sizes says which fillings to
    use how often; actual pieces take the places of rounded ones; then short pieces go, longest first, where they leave
    least room. All this needs the histogram of lengths only, which has at most `capacity` entries whatever the input;
    the plan's own size depends on the groups and lengths, not on the rows. Pieces of one length are ranked over many
    tasks and read their place from the plan by an equality join on the length. Sequences have no gaps.
    """
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    made = Plan(histogram, capacity, groups)
    by_length = defaultdict(list)
    for length, *entry in made.entries:
        by_length[length].append(tuple(entry))
    entry = "struct<first:long,count:long,times:long,sequence:long,offset:long>"
    table = parts.sparkSession.createDataFrame([(k, sorted(v)) for k, v in by_length.items()], f"length long, entries array<{entry}>")
    ranked = running(parts, ["length"], ["doc_id", "piece", "start"], sum(histogram.values()), "_rank")
    found = ranked.join(F.broadcast(table), "length").withColumn("_e", F.element_at(F.filter("entries", lambda e: e["first"] <= F.col("_rank")), -1))
    at = F.col("_rank") - F.col("_e.first")
    sequence = F.col("_e.sequence") + at % F.col("_e.count")
    offset = F.col("_e.offset") + F.floor(at / F.col("_e.count")).cast("long") * F.col("length")
    return found.select(*parts.columns, sequence.alias("sequence_id"), offset.alias("offset"))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """`docs` (doc_id, text) as sequences of at most `capacity` ids: a row for each piece (see `pieces` and `pack`)."""
    return pack(materialise(pieces(docs, tokenizer, capacity, ids=ids), "pieces"), capacity)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of at most 2048 tokens, a row for each piece; see `pieces` and `pack`.

    A null or empty text is the end id alone; repeated rows are documents of their own; further columns play no part; an
    empty table gives no rows.
    """
    out = packed(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}
