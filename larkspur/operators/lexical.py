"""BM25 retrieval over exact document lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import token_count, tokenize, words
from larkspur.operators import storage

K1, B = 0.82, 0.68
#: Characters of text that one task counts; query terms that are sent to all tasks at most; hits that a task may keep; sums it makes at once.
CHARACTERS, MOST_TERMS, MOST_HITS, SUMS = 8 << 20, 1 << 20, 1 << 20, 1 << 22


def build_queries(turns: DataFrame, kind: str, repeats: int = 1, c: float = 1.0) -> DataFrame:
    """qid, query of a rewrite record. concat: the rewrite `repeats` times, then the response, nothing between; concat_auto:
    as often as the response is longer in words, over c, rounded half to even. Rows without a query go (an empty rewrite in
    concat_auto has none)."""
    rewrite, response = F.col("rewrite_utt_text"), F.col("response_utt_text")
    ratio = F.try_divide(F.size(words(response)).cast("double"), F.size(words(rewrite)).cast("double")) / F.lit(float(c))
    kinds = {
        "rewrite": rewrite,
        "concat": F.concat(F.repeat(rewrite, F.lit(repeats)), response),
        "concat_auto": F.concat(F.repeat(rewrite, F.bround(ratio, 0).cast("int")), response),
        "oracle": F.col("oracle_utt_text"),
        "response": response,
    }
    if kind == "fusion":
        query = F.col("fusion")
    elif kind in kinds:
        query = kinds[kind]
    else:
        raise ValueError(f"query type {kind}")
    return turns.select(F.col("sample_id").alias("qid"), query.alias("query")).filter(F.col("query").isNotNull())


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, qtf"""
    rows = queries.select("qid", F.explode_outer(tokenize(F.col("query"))).alias("term")).filter("term is not null")
    return rows.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def dealt(passages: DataFrame) -> DataFrame:
    """pid, text, dealt by pid in parts of about CHARACTERS, whose number is fixed: small parts are not joined again.

    What is then grouped by pid and more needs no further exchange, and no task counts more than about a part.
    """
    whole = passages.select("pid", F.col("text").cast("string").alias("text"))
    size = whole.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    return whole.repartition(max(int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // CHARACTERS)), "pid")


def _tokens(passages: DataFrame) -> DataFrame:
    """pid, dl, toks: each text is cut into tokens once, and its length is theirs."""
    return passages.select("pid", tokenize(F.col("text")).alias("toks")).select("pid", F.coalesce(F.size("toks"), F.lit(0)).alias("dl"), "toks")


def postings(passages: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """pid, dl, term, tf; only of `terms` (term), if given: tokens are cut down to them before they are counted.

    Whole texts are dealt by pid first, as they are smaller than their counts, which then need no further exchange.
    """
    return _counted(_tokens(dealt(passages)), terms)


def _counted(tokens: DataFrame, terms: DataFrame | None) -> DataFrame:
    # an inner explode would be given a filter that tokenises every text twice more below the generator
    rows = tokens.select("pid", "dl", F.explode_outer("toks").alias("term")).filter("term is not null")
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    return rows.groupBy("pid", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_statistics(found: DataFrame) -> DataFrame:
    """term, df, cf"""
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def search(passages: DataFrame, queries: DataFrame, k: int = 1000, k1: float = K1, b: float = B) -> DataFrame:
    """qid, pid, score (6 places), rank: the k best passages of each query that share a term; ties by pid.

    Only query terms are counted in passages. Up to MOST_TERMS query terms (and MOST_HITS results), texts are dealt by pid
    once and counted once; counts are written to the shared folder, a row a passage, and scored from there in blocks, k rows
    a query of each task being all that is shuffled by query. More are joined by a shuffle. For more than one search build
    an index.
    """
    wanted = query_terms(queries)
    if wanted.limit(MOST_TERMS + 1).count() <= MOST_TERMS and wanted.select("qid").distinct().count() * k <= MOST_HITS:
        return _search_few(passages, wanted, k, k1, b)
    found = postings(passages, wanted.select("term").distinct())
    size = passages.select(token_count(F.col("text")).alias("dl")).agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).alias("s")).scalar()
    # said with tf, so that both uses of the counts are one plan and read one exchange of texts
    df = found.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("df"))
    return _ranked(found, wanted.join(df, "term"), size["n"], size["avgdl"], k, k1, b)


def _search_few(passages: DataFrame, wanted: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """`search` for query terms (qid, term, qtf) that every task may hold."""
    spark, sizes = passages.sparkSession, Observation()
    tokens = _tokens(dealt(passages)).observe(sizes, F.count(F.lit(1)).alias("n"), F.count("toks").alias("texts"), F.sum("dl").alias("words"))
    counts = _counted(tokens, F.broadcast(wanted.select("term").distinct()))
    # the partitioning by pid holds for these groups too
    held = storage.kept(counts.groupBy("pid").agg(F.collect_list(F.struct("term", "tf", "dl")).alias("found")), storage.scratch(spark, "counts"))
    n, mean = sizes.get["n"], (sizes.get["words"] or 0) / max(1, sizes.get["texts"])  # null texts have no length
    df = held.select(F.explode(F.transform("found", lambda x: x["term"])).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = wanted.join(df, "term").select("qid", "term", (F.col("qtf") * idf).alias("w")).toArrow().sort_by("term")
    form = f"qid {wanted.schema['qid'].dataType.simpleString()}, pid {held.schema['pid'].dataType.simpleString()}, score double"
    storage.small_batches(spark)
    hits = held.mapInArrow(lambda batches: _best_hits(batches, asked, k, k1, b, mean), form)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "pid")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _best_hits(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int, k1: float, b: float, mean: float) -> Iterator[pa.RecordBatch]:
    """qid, pid, score: the k best of passages (pid, found: term, tf, dl) for each query of `asked` (qid, term, w; by term).

    Held are k hits a query and, between two cuts, about as many again; a query's floor is its k-th best score so far.
    """
    qids, terms = asked["qid"].combine_chunks().dictionary_encode("encode"), asked["term"].combine_chunks().dictionary_encode()
    of, weights, names = qids.indices.to_numpy(), asked["w"].to_numpy(), qids.dictionary
    first = np.searchsorted(terms.indices.to_numpy(), np.arange(len(terms.dictionary) + 1))
    floors, kept, more = np.full(len(names), -np.inf), [], 0

    def cut(found: list) -> list:
        q, s, pids = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), pa.chunked_array([f[2] for f in found]).combine_chunks()
        order = np.lexsort((pc.rank(pids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(), -s, q))
        q, s = q[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(names)))[q]
        floors[q[rank == k - 1]] = s[rank == k - 1]
        return [(q[rank < k], s[rank < k], pids.take(pa.array(order[rank < k])))]

    for batch in batches:
        for at, to, row, post, place in meetings(batch, terms.dictionary, first, len(names)):
            tf, dl = post["tf"], post["dl"]
            part = tf / (tf + k1 * (1 - b + b * dl / mean)) * weights[place]
            sums = np.bincount(row * len(names) + of[place], part, (to - at) * len(names)).reshape(to - at, -1)
            scores = np.round(sums, 6)
            i, q = np.nonzero((sums > 0) & (scores >= floors))
            kept.append((q, scores[i, q], batch.column("pid").take(pa.array(at + i))))
            more += len(i)
            if more > k * len(names) + (1 << 16):
                kept, more = cut(kept), 0
    if kept:
        for q, s, pids in cut(kept):
            for at in range(0, len(q), 65_536):
                z = slice(at, at + 65_536)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q[z])), pids[z], pa.array(s[z])], names=["qid", "pid", "score"])


def meetings(batch: pa.RecordBatch, terms: pa.Array, first: np.ndarray, width: int) -> Iterator[tuple]:
    """Postings of a batch of passages (found: a list of term and more) with what is asked for their terms, in blocks of about
    SUMS pairs and SUMS sums (passages times `width`): from, to (passages), each pair's passage in the block, its posting's fields, its place among what is asked.

    What is asked stands by term: that of the i-th of `terms` from first[i] to first[i + 1]. Other terms are left out.
    """
    lists = batch.column("found")
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
    code = pc.fill_null(pc.index_in(flat.field("term"), terms), -1).to_numpy()
    known = code >= 0
    row, code = np.repeat(np.arange(batch.num_rows), sizes)[known], code[known]
    fields = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False)[known] for f in flat.type if f.name != "term"}
    spans = first[code + 1] - first[code]
    ends = np.searchsorted(row, np.arange(batch.num_rows), "right")
    upto = np.concatenate([[0], np.cumsum(spans)])
    at = 0
    while at < batch.num_rows:
        a = ends[at - 1] if at else 0
        fit = np.searchsorted(upto[ends], upto[a] + SUMS, "right")
        to = max(at + 1, min(batch.num_rows, at + SUMS // max(1, width), int(fit)))
        z = np.arange(a, ends[to - 1])
        n = spans[z]
        if n.sum():
            place, each = np.arange(n.sum()) + np.repeat(first[code[z]] - (np.cumsum(n) - n), n), np.repeat(z, n)
            yield at, to, row[each] - at, {name: x[each] for name, x in fields.items()}, place
        at = to


def _ranked(found: DataFrame, wanted: DataFrame, n: Column, avgdl: Column, k: int, k1: float, b: float) -> DataFrame:
    """The k best of postings (pid, dl, term, tf) for query terms (qid, term, qtf, df) in n passages of average length."""
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = wanted.select("qid", "term", "qtf", idf.alias("idf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    scored = found.join(weighted, "term").groupBy("qid", "pid").agg(F.round(F.sum(part), 6).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "pid")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def write_index(passages: DataFrame, path: str, buckets: int = 64) -> None:
    """An index of all terms as Parquet: postings in folders by the term's bucket, sorted by term, document frequencies and sizes.

    Postings are dealt by (bucket, pid), so that a term of most passages is no single task's.
    """
    spark = passages.sparkSession
    found = postings(passages).withColumn("bucket", _bucket(F.col("term"), buckets))
    dealt = found.repartition("bucket", F.pmod(F.xxhash64("pid"), F.lit(16))).sortWithinPartitions("bucket", "term", "pid")
    dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    term_statistics(written).withColumn("bucket", _bucket(F.col("term"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/terms")
    sizes = passages.select(token_count(F.col("text")).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    sizes.withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 1000, k1: float = K1, b: float = B) -> DataFrame:
    """What `search` returns, from a written index: only folders and row groups of the queries' terms are read."""
    size = spark.read.parquet(f"{path}/sizes").first()
    wanted = query_terms(queries).withColumn("bucket", _bucket(F.col("term"), size["buckets"]))
    df = wanted.join(spark.read.parquet(f"{path}/terms"), ["bucket", "term"]).select("qid", "bucket", "term", "qtf", "df")
    found = spark.read.parquet(f"{path}/postings").join(df.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").drop("bucket")
    return _ranked(found, df, F.lit(size["n"]), F.lit(size["avgdl"]), k, k1, b)
