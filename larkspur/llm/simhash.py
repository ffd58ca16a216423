"""Operator 4: SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import boxed, materialise, read_table, small_batches, unboxed

BITS = 64


def fingerprint(text: str | bytes | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of a text's word shingles; 0 if it has no words."""
    raw = (text or b"") if isinstance(text, (bytes, type(None))) else text.encode("utf-8", "surrogatepass")
    found = raw.lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return 0
    shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words))))) if len(found) >= words else [b" ".join(found)]
    ones, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(shingles), 65_536):
        part = shingles[at : at + 65_536]
        h = np.fromiter((digest(s, seed) for s in part), dtype="<u8", count=len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for every row; the whole text, null as empty."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out = np.fromiter((fingerprint(t.as_py(), words, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one must differ by at most one bit.

    With m segments that each differ by two bits or more, 2 m bits differ: m = distance // 2 + 1 leaves one below.
    """
    m = distance // 2 + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _mask(first: int, width: int) -> int:
    return _signed(((1 << width) - 1) << first)


def links(fps: DataFrame, distance: int = 4, pieces: int | None = None) -> DataFrame:
    """a, b (a < b): all pairs of the distinct longs `fp` that differ by 1 to `distance` bits, each once.

    Each fingerprint is indexed under one key for each segment and each bit of it taken as wildcard; two that differ by
    at most one bit in a segment share a key. The equality join verifies inside its condition, so candidates are never
    rows, and keeps a pair only under the first key that the two share, so that it comes out once.

    A key has about 20 bits. For more fingerprints than 2^25 (or as told) the bits outside the segment, of which at most
    `distance` differ, are cut into `pieces` = distance + 1, of which one is equal: each key then comes once a piece and
    is longer by its bits. The links are the same; the index has `pieces` times the rows, buckets are smaller by far more.
    """
    if pieces is None:
        pieces = 1 if fps.count() <= 1 << 25 else distance + 1
    cuts = segments(distance)
    outside = []  # of each segment, the masks of the pieces of all other bits
    for low, width in cuts:
        bits = [b for b in range(BITS) if not low <= b < low + width]
        edges = [len(bits) * i // pieces for i in range(pieces + 1)]
        outside.append([_signed(sum(1 << b for b in bits[i:j])) for i, j in zip(edges, edges[1:])] if pieces > 1 else [0])
    masks = [_mask(*cut) & ~_mask(w, 1) | more for cut, others in zip(cuts, outside) for w in range(cut[0], sum(cut)) for more in others]
    index = fps.select("fp", F.posexplode(F.lit(masks).cast("array<long>")).alias("place", "mask")).select("fp", "place", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
    a, b = F.col("l.fp"), F.col("r.fp")
    wild, piece = F.floor(F.col("l.place") / pieces), F.col("l.place") % pieces
    differ = a.bitwiseXOR(b)
    unlike = lambda mask: differ.bitwiseAND(F.lit(mask)) != 0
    first = F.lit(False)
    for s, (low, width) in enumerate(cuts):
        here = wild.between(low, low + width - 1) & ((wild == low) | unlike(_mask(low, width)))
        for earlier in cuts[:s]:
            here = here & (F.bit_count(differ.bitwiseAND(F.lit(_mask(*earlier)))) >= 2)
        for p in range(pieces - 1):
            here = here & ((piece <= p) | unlike(outside[s][p]))
        first = first | here
    same_key = (F.col("l.place") == F.col("r.place")) & (F.col("l.rest") == F.col("r.rest"))
    # one table under two names, so that both sides read one exchange
    return index.alias("l").join(index.alias("r").hint("merge"), same_key & (a < b) & (F.bit_count(differ) <= distance) & first).select(a.alias("a"), b.alias("b"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """vertex, root: for every vertex of the edges (a, b: long) the smallest of its component.

    Alternates large-star and small-star steps; each round ends in the shared folder. Minima are pre-aggregated before
    the shuffle and joined back, so no vertex's neighbours are ever gathered in one place. Joins are by shuffle, as each
    round's broadcasts would stay with the driver; what tells two rounds apart is counted while a round is written.
    """
    now, mark = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least.hint("merge"), "u")
        small = hung.select("u", F.col("m").alias("v")).union(hung.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        told = Observation()
        now = materialise(small.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
        seen = told.get
        if seen == mark:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        mark = seen
    raise RuntimeError("components: no fixed point")


def _grouped(marked: DataFrame, distance: int) -> DataFrame:
    """fp, root, component_id of every fingerprint of `marked` (doc_id, fp): its component and the smallest doc_id there."""
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    pairs = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(pairs.withColumnRenamed("vertex", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest.hint("merge"), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at most `distance` bits) for every row.

    Rows with equal fingerprints are one vertex. Null or empty texts have fingerprint 0 and link like any other; null
    doc_ids never are the smallest unless a component has no other, which then is null. Empty tables give no rows.
    """
    marked = materialise(fingerprints(docs, words, seed), "fingerprints")
    return marked.join(_grouped(marked, distance).hint("merge"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """One row of `docs` of each component: that of the smallest doc_id, and of several with that id one text's.

    Rows are told apart by doc_id and text, so an id that comes again with another text stands for that text alone; of
    rows alike in both one stays. Rows without doc_id all stay, and take no other row's place.
    """
    rows = boxed(docs).withColumn("_tie", F.xxhash64("text"))
    known = rows.filter("doc_id is not null")
    named = known.select(F.struct("doc_id", "_tie").alias("doc_id"), "text")
    marked = materialise(fingerprints(named, words, seed), "fingerprints")
    kept = marked.join(_grouped(marked, distance).hint("merge"), "fp").groupBy("root").agg(F.min("doc_id").alias("kept")).select("kept.*")
    once = known.join(kept.hint("merge"), ["doc_id", "_tie"], "left_semi").dropDuplicates(["doc_id", "_tie"])
    return unboxed(once.unionByName(rows.filter("doc_id is null")), docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all `documents`, a row for each row; see `near_duplicates`.

    Null, empty and blank texts have fingerprint zero, which links like any other; repeated rows stay; further columns play
    no part; an empty table gives no rows.
    """
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE_SQL: dict[str, str] = {}
