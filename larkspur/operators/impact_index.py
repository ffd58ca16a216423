"""BM25 over an index of segments, whose postings stand in blocks by impact, so that most blocks need not be read."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators import lexical, storage
from larkspur.operators.lexical import K1, B, _bucket, postings, query_terms

BLOCKS = "term string, shard int, part int, max_tf long, min_dl int, pids array<string>, tfs array<long>, dls array<int>, segment string, level int, bucket int"
TERMS = "term string, df long, shards int, segment string, bucket int"
#: Scores are rounded to six places, so what is this much below the k-th best cannot be among them.
CLOSE = 2e-6


def _hash(pid: Column) -> Column:
    return F.xxhash64(pid).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def _shard(pid: Column, shards: Column) -> Column:
    return F.pmod(_hash(pid), shards).cast("int")


def _part(pid: Column, level: Column) -> Column:
    return F.pmod(F.shiftright(_hash(pid), 24), F.pow(F.lit(2.0), level).cast("long")).cast("int")


class _Asked:
    """Query terms (qid, term, w, to and more), by term, and what postings of levels below `to` add to the queries' sums."""

    def __init__(self, rows: DataFrame, impact):
        self.rows, self.impact = rows.toArrow().sort_by([("term", "ascending"), ("qid", "ascending")]).combine_chunks(), impact
        column = lambda name: self.rows[name].combine_chunks()
        qids, terms = column("qid").dictionary_encode("encode"), column("term").dictionary_encode()
        self.of, self.names, self.terms = qids.indices.to_numpy(), qids.dictionary, terms.dictionary
        self.first = np.searchsorted(terms.indices.to_numpy(), np.arange(len(self.terms) + 1))
        self.value = {f.name: column(f.name).to_numpy() for f in self.rows.schema if f.name not in ("qid", "term")}

    def meet(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """from, to, each pair's key (passage times queries plus query), place and sum, in blocks of passages."""
        for at, to, row, post, place in lexical.meetings(batch, self.terms, self.first, len(self.names)):
            read = post["level"] < self.value["to"][place]
            place, c = place[read], self.impact(post["tf"][read], post["dl"][read]) * self.value["w"][place[read]]
            yield at, to, row[read] * len(self.names) + self.of[place], place, c

    def best_sums(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """qid, s: the k largest sums of each query."""
        best = np.zeros((0, len(self.names)))
        for batch in batches:
            for at, to, key, _, c in self.meet(batch):
                best = np.concatenate([best, np.bincount(key, c, (to - at) * len(self.names)).reshape(to - at, -1)])
                best = np.partition(best, -k, axis=0)[-k:] if len(best) > k else best
        i, q = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([self.names.take(pa.array(q)), pa.array(best[i, q])], names=["qid", "s"])

    def candidates(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """qid, pid, s, had: passages whose sums s could still reach their query's floor, with the terms that have been met."""
        width, v = len(self.names), self.value
        floor, ceiling = np.zeros(width), np.zeros(width)
        floor[self.of], ceiling[self.of] = v["floor"], v["ceiling"]
        for batch in batches:
            for at, to, key, place, c in self.meet(batch):
                s, paid, met = (np.bincount(key, x, (to - at) * width) for x in (c, v["owed"][place], None))
                good = (met > 0) & (s + np.tile(ceiling, to - at) - paid >= np.tile(floor, to - at) - CLOSE)
                who, mine = np.flatnonzero(good), good[key]
                order = np.argsort(key[mine], kind="stable")
                had = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(met[who])]), pa.int32()), self.rows["term"].combine_chunks().take(pa.array(place[mine][order])))
                yield pa.RecordBatch.from_arrays([self.names.take(pa.array(who % width)), batch.column("pid").take(pa.array(at + who // width)), pa.array(s[who]), had], names=["qid", "pid", "s", "had"])


class ImpactIndex:
    """An index in a folder: immutable segments, one for each delivery or merge, and a manifest of those that count.

    A term's postings are ranked by their impact (what they add to a score) in shards of its passages. The first `block`
    of a shard are level 0; each further level has twice as many, in blocks of about that size by a hash of the passage, so
    the block that a passage is in is known. A block says its largest count and shortest passage, which bound the impact
    of all in it whatever the average length has become since. Folders are by segment, level and bucket of the term.

    Passages (pid, text) of different deliveries must have different pids; pids are kept as strings. Null texts count as
    passages without words.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, block: int = 128, shard: int = 65_536):
        self.spark, self.path, self.buckets, self.block, self.shard = spark, path.rstrip("/"), buckets, block, shard
        self.manifest = storage.Manifest(spark, f"{self.path}/manifest")

    # --- building ---

    def segments(self) -> list[dict]:
        """id, n (passages), words of each segment that counts."""
        return (self.manifest.last()[1] or {"segments": []})["segments"]

    def add(self, passages: DataFrame) -> str:
        """Indexes a delivery as a new segment; the others are not read. A failure leaves the index as it was."""
        number, state = self.manifest.last()
        segment = uuid.uuid4().hex
        raw = storage.kept(postings(passages).withColumn("pid", F.col("pid").cast("string")), f"{self.path}/building/{segment}")
        made = self._write(raw, segment, passages.count())
        self._commit(number, [*(state or {"segments": []})["segments"], made])
        return segment

    def merge(self) -> str:
        """Puts all segments into one. Old ones stay readable for whoever reads the state before; `prune` drops them."""
        number, _ = self.manifest.last()
        segments, segment = self.segments(), uuid.uuid4().hex
        rows = self._blocks(segments).select("term", F.explode(F.arrays_zip("pids", "tfs", "dls")).alias("p")).select(F.col("p.pids").alias("pid"), F.col("p.dls").alias("dl"), "term", F.col("p.tfs").alias("tf"))
        raw = storage.kept(rows, f"{self.path}/building/{segment}")
        self._commit(number, [self._write(raw, segment, sum(s["n"] for s in segments))])
        return segment

    def prune(self) -> list[str]:
        """Deletes what no longer counts or never did; returns the segments' names."""
        known = {f"segment={s['id']}" for s in self.segments()}
        gone = {name for kind in ("blocks", "terms") for name in storage.names(self.spark, f"{self.path}/{kind}") if name.startswith("segment=") and name not in known}
        for name in gone:
            for kind in ("blocks", "terms"):
                storage.delete(self.spark, f"{self.path}/{kind}/{name}")
        storage.delete(self.spark, f"{self.path}/building")
        return sorted(name.removeprefix("segment=") for name in gone)

    def _commit(self, number: int, segments: list[dict]) -> None:
        self.manifest.put(number, {"buckets": self.buckets, "segments": segments})
        for s in segments:
            storage.delete(self.spark, f"{self.path}/building/{s['id']}")

    def _write(self, raw: DataFrame, segment: str, n: int) -> dict:
        """Blocks of postings (pid, dl, term, tf). A frequent term's postings are dealt over its shards before they are ranked."""
        words = raw.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        mean = max(1.0, words / max(1, n))
        shards = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("df") / self.shard)).cast("double"))).cast("int")
        terms = raw.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("shards", shards)
        terms = storage.kept(terms, f"{self.path}/building/{segment}-terms")
        marked = terms.withColumn("bucket", _bucket(F.col("term"), self.buckets))
        marked.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/terms/segment={segment}")
        impact = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
        ranked = raw.join(terms, "term").withColumn("shard", _shard(F.col("pid"), F.col("shards")))
        rank = F.row_number().over(Window.partitionBy("term", "shard").orderBy(impact.desc(), "pid")) - 1
        ranked = ranked.withColumn("level", F.floor(F.log2(rank / self.block + 1)).cast("int")).withColumn("part", _part(F.col("pid"), F.col("level")))
        # the window's partitioning holds for these groups too
        found = F.sort_array(F.collect_list(F.struct("pid", "tf", "dl")))
        blocks = ranked.groupBy("term", "shard", "level", "part").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), found.alias("p"))
        blocks = blocks.select("term", "shard", "part", "max_tf", "min_dl", *[F.col(f"p.{c}").alias(f"{c}s") for c in ("pid", "tf", "dl")], "level", _bucket(F.col("term"), self.buckets).alias("bucket"))
        dealt = blocks.repartition("level", "bucket", F.pmod("shard", F.lit(64)), F.pmod("part", F.lit(64)))
        dealt.sortWithinPartitions("level", "bucket", "term", "shard", "part").write.partitionBy("level", "bucket").parquet(f"{self.path}/blocks/segment={segment}")
        storage.delete(self.spark, f"{self.path}/building/{segment}-terms")
        return {"id": segment, "n": n, "words": words}

    # --- reading ---

    def _read(self, kind: str, schema: str, segments: list[dict]) -> DataFrame:
        # a segment without postings has no files
        paths = [f"{self.path}/{kind}/segment={s['id']}" for s in segments if any(x.startswith(("level=", "bucket=")) for x in storage.names(self.spark, f"{self.path}/{kind}/segment={s['id']}"))]
        return self.spark.read.option("basePath", f"{self.path}/{kind}").schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _blocks(self, segments: list[dict]) -> DataFrame:
        return self._read("blocks", BLOCKS, segments)

    def search(self, queries: DataFrame, k: int = 1000, k1: float = K1, b: float = B, report: dict | None = None, step: float = 0.5, slack: float = 0.5) -> DataFrame:
        """qid, pid, score (6 places), rank: the same rows as `lexical.search` over all passages of all segments.

        Blocks are read in rounds: in each those levels of a query's terms that can add at least `tau` to a score, which
        falls by `step`; so a frequent word's blocks are mostly left. After a round, a query's k-th best sum so far is a
        floor under its k-th best score, and the bounds of its terms' further levels make a ceiling over all passages not
        met yet; once that is below the floor (by `slack`, as nearly as much would leave many to be completed), the query
        needs no new passages. Of those met, the ones that could still reach the floor get their missing terms from the
        blocks that these passages would be in; no other block is read. A block is read once and its postings are written to
        the shared folder; they are dealt by passage and summed up for all queries in blocks, so no row is made for each
        passage, query and term. Query terms come to the driver and go to all tasks: at most lexical.MOST_TERMS of them (and
        MOST_HITS results) at a time, more are searched for in groups of queries.

        `report` gets the blocks that hold the queries' terms and those read, the same by query (pairs, scored), and the
        rounds.
        """
        size = query_terms(queries).agg(F.count(F.lit(1)), F.count_distinct("qid")).first()
        groups = max(-(-size[0] // lexical.MOST_TERMS), min(size[1], -(-size[1] * k // lexical.MOST_HITS)), 1)
        if groups > 1 and report is None:
            of = lambda i: queries.filter(F.pmod(F.xxhash64(F.col("qid").cast("string")), F.lit(2 * groups)) == i)
            return functools.reduce(DataFrame.union, [self._search(of(i), k, k1, b, None, step, slack) for i in range(2 * groups)])
        return self._search(queries, k, k1, b, report, step, slack)

    def _search(self, queries: DataFrame, k: int, k1: float, b: float, report: dict | None, step: float, slack: float) -> DataFrame:
        segments = self.segments()
        n, words = sum(s["n"] for s in segments), sum(s["words"] for s in segments)
        mean = max(words / n, 1e-9) if n else 1.0
        work = storage.scratch(self.spark, "search")
        blocks = self._blocks(segments)
        wanted = query_terms(queries.withColumn("qid", F.col("qid").cast("string"))).withColumn("bucket", _bucket(F.col("term"), self.buckets))
        stats = storage.kept(wanted.select("bucket", "term").distinct().join(self._read("terms", TERMS, segments), ["bucket", "term"]), f"{work}/stats")
        df = stats.groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = storage.kept(wanted.join(df, "term").select("qid", "bucket", "term", (F.col("qtf") * idf).alias("w")), f"{work}/weights")
        impact = lambda tf, dl: tf / (tf + k1 * (1 - b + b * dl / mean))
        mine = blocks.join(stats.select("segment", "bucket", "term"), ["segment", "bucket", "term"], "left_semi")
        meta = storage.kept(mine.select("segment", "bucket", "level", "term", "shard", "part", impact(F.col("max_tf"), F.col("min_dl")).alias("bound")), f"{work}/meta")
        total, last = meta.agg(F.count(F.lit(1)), F.coalesce(F.max("level"), F.lit(-1))).first()
        # of each term the largest bound at a level or beyond; 0 behind the last
        each = meta.groupBy("term", "level").agg(F.max("bound").alias("bound")).groupBy("term").agg(F.collect_list(F.struct("level", "bound")).alias("found"))
        beyond = F.transform(F.sequence(F.lit(0), F.lit(last + 1)), lambda at: F.coalesce(F.array_max(F.transform(F.filter("found", lambda x: x["level"] >= at), lambda x: x["bound"])), F.lit(0.0)))
        weights = all_weights = storage.kept(weights.join(each.select("term", beyond.alias("beyond")), "term"), f"{work}/bounds")

        # a term's levels that can add at least `tau` to a score
        upto = F.size(F.filter("beyond", lambda x: F.col("w") * x >= F.col("tau")))
        most = weights.groupBy("qid").agg(F.max(F.col("w") * F.get("beyond", F.lit(0))).alias("most"))
        open_ = most.select("qid", (F.col("most") * step).alias("tau"))
        weights = weights.withColumn("from", F.lit(0))
        keys = ["segment", "level", "bucket", "term", "shard", "part"]
        form = "pid string, term string, level int, tf long, dl int"
        ended, rounds = [], 0
        storage.small_batches(self.spark)
        while last >= 0:
            now = storage.kept(weights.join(open_, "qid").withColumn("to", upto), f"{work}/now/round={rounds}")
            spans = now.filter(F.col("to") > F.col("from")).withColumn("level", F.explode(F.sequence("from", F.col("to") - 1)))
            pairs = storage.kept(meta.join(spans.select("qid", "bucket", "term", "w", "level"), ["bucket", "term", "level"]), f"{work}/pairs/round={rounds}")
            now_read = pairs.select(*keys).distinct()
            if rounds:  # for other queries before
                now_read = now_read.join(self.spark.read.schema(pairs.schema).parquet(*[f"{work}/pairs/round={i}" for i in range(rounds)]).select(*keys), keys, "left_anti")
            p = F.explode(F.arrays_zip("pids", "tfs", "dls")).alias("p")
            found = blocks.join(now_read, keys, "left_semi").select("term", "level", p).select(F.col("p.pids").alias("pid"), "term", "level", F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
            found.write.parquet(f"{work}/postings/round={rounds}")
            rounds += 1
            read = self.spark.read.schema(form).parquet(*[f"{work}/postings/round={i}" for i in range(rounds)])
            read = read.groupBy("pid").agg(F.collect_list(F.struct("term", "level", "tf", "dl")).alias("found"))
            asked = _Asked(now.select("qid", "term", "w", "to"), impact)
            sums = read.mapInArrow(lambda batches, asked=asked: asked.best_sums(batches, k), "qid string, s double")
            top = sums.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s")))).filter(F.col("r") <= k)
            floor = top.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(F.lit(0.0)).alias("floor"))
            ceiling = now.groupBy("qid", "tau").agg(F.sum(F.col("w") * F.get("beyond", F.col("to"))).alias("ceiling"))
            state = storage.kept(ceiling.join(floor, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))), f"{work}/state/round={rounds}")
            goes_on = (F.col("ceiling") > 0) & (F.col("ceiling") > F.col("floor") * slack - CLOSE)
            ended.append(state.filter(~goes_on))
            open_ = state.filter(goes_on).select("qid", (F.col("tau") * step).alias("tau"))
            weights = now.drop("tau", "from").withColumnRenamed("to", "from")
            if open_.isEmpty():
                break
        if not rounds:
            return self.spark.createDataFrame([], "qid string, pid string, score double, rank int")
        done = functools.reduce(DataFrame.union, ended).select("qid", "tau", "floor", "ceiling")
        # passages that could still be among the best: what they lack is bounded by their query's unread levels
        terms = all_weights.join(done, "qid").withColumn("next", upto).withColumn("owed", F.col("w") * F.get("beyond", F.col("next")))
        terms = storage.kept(terms.select("qid", "bucket", "term", "w", "next", "owed", "floor", "ceiling"), f"{work}/terms")
        asked = _Asked(terms.select("qid", "term", "w", F.col("next").alias("to"), "owed", "floor", "ceiling"), impact)
        candidates = storage.kept(read.mapInArrow(lambda batches: asked.candidates(batches), "qid string, pid string, s double, had array<string>"), f"{work}/candidates")
        lacking = candidates.join(terms.filter("owed > 0").select("qid", "bucket", "term", "w", "next"), "qid").filter(~F.array_contains("had", F.col("term"))).select("qid", "pid", "bucket", "term", "w", "next")
        spots = lacking.join(stats.select("segment", "bucket", "term", "shards"), ["bucket", "term"]).withColumn("level", F.explode(F.sequence("next", F.greatest("next", F.lit(last)))))
        spots = spots.withColumn("shard", _shard(F.col("pid"), F.col("shards"))).withColumn("part", _part(F.col("pid"), F.col("level")))
        needed = storage.kept(meta.join(spots.select("qid", *keys).distinct(), keys).select("qid", *keys), f"{work}/needed")
        # a posting belongs to what a candidate lacks, or it is of no use
        late = blocks.join(needed.select(*keys).distinct(), keys, "left_semi").select("term", F.explode(F.arrays_zip("pids", "tfs", "dls")).alias("p"))
        late = late.select("term", F.col("p.pids").alias("pid"), impact(F.col("p.tfs"), F.col("p.dls")).alias("i")).join(lacking.select("qid", "pid", "term", "w"), ["pid", "term"])
        parts = candidates.select("qid", "pid", F.col("s").alias("c")).union(late.select("qid", "pid", F.col("w") * F.col("i")))
        if report is not None:
            met = self.spark.read.schema(pairs.schema).parquet(*[f"{work}/pairs/round={i}" for i in range(rounds)]).select("qid", *keys)
            both = met.union(needed)
            held = meta.join(all_weights.select("qid", "bucket", "term"), ["bucket", "term"]).count()
            report |= {"blocks": total, "read": both.select(*keys).distinct().count(), "pairs": held, "scored": both.distinct().count(), "rounds": rounds}
        scored = parts.groupBy("qid", "pid").agg(F.round(F.sum("c"), 6).alias("score"))
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "pid")
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
