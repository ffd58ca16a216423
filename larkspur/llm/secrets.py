"""Operator 5: secret scans over an incremental, content-addressed blob ledger (built-in functions only)."""

from __future__ import annotations

import functools
import hashlib
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import boxed, hash_bits, let, read_table, scratch_path, unboxed

#: kind, pattern, the group whose length counts, its least length, and signs, of which every match holds one (none: no
#: sign is looked for); in the order in which kinds are listed. After the base kinds come formats that give themselves
#: away (fixed values).
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ()),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, ("AKIA",)),  # of AKIA[A-Z0-9]+ only matches of 20 or more count: runs are maximal
    ("hex", r"[0-9a-f]{24,}", 0, 24, ()),
    ("host_token", r"(gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,})", 0, 40, ("gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_")),
    ("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    ("signed_token", r"eyJ[A-Za-z0-9_-]{10,1000}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 20, ("eyJ",)),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 40, ("PRIVATE KEY-----",)),
    ("url_password", r"(https?|s?ftp|ssh|smtps?|ldaps?|mysql|postgres|postgresql|mongodb|rediss?|amqps?)://[^/\s:@?#]+:[^/\s@?#]+@", 0, 8, ("://",)),
)
#: The kinds whose spans are counted and digested as the base.
BASE = ("assign", "access", "hex")
#: Changes with any rule, so that findings of an edited rule are never those of the old one.
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
SPAN = "array<struct<start:int,order:int,kind:string,end:int>>"
_OPEN, _CLOSE = "\u0001", "\u0002"


def _before(values: Column, op) -> Column:
    """For each of an array of ints `op` (sum, maximum) over all before it, 0 for the first.

    A step copies what it has so far, so the array goes in chunks of about the root of its length: n values cost n times
    that root, not n times n.
    """

    def fold(part):
        step = lambda acc, v: F.struct(op(acc["all"], v).alias("all"), F.concat(acc["each"], F.array(acc["all"])).alias("each"))
        return F.aggregate(part, F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("each")), step)

    def chunked(values):
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(values)))).cast("int")
        count = F.ceil(F.size(values) / size).cast("int")
        chunks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda c: fold(F.slice(values, (c - 1) * size + 1, size)))
        shifted = lambda chunks: F.zip_with(chunks, fold(F.transform(chunks, lambda c: c["all"]))["each"], lambda c, base: F.transform(c["each"], lambda x: op(x, base)))
        return let(chunks, lambda c: F.flatten(shifted(c)))

    return let(values, chunked)


def _matches(clean: Column, order: int, kind: str, pattern: str, group: int, least: int, signs: tuple[str, ...]) -> Column:
    """All matches of one rule, left to right, as spans in code points, in a text without the two marks.

    Matches are put between the marks; the pieces between marks then alternate, and their lengths add up to places.
    """
    pieces = F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), f"[{_OPEN}{_CLOSE}]")

    def spans(pieces):
        at = _before(F.transform(pieces, lambda p: F.length(p)), lambda a, b: a + b)

        def span(piece, i):
            counts = (i % 2 == 1) & (F.length(F.regexp_extract(piece["p"], pattern, group)) >= least)
            return F.when(counts, F.struct(piece["at"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (piece["at"] + F.length(piece["p"])).alias("end")))

        return F.filter(F.transform(F.zip_with(pieces, at, lambda p, a: F.struct(p.alias("p"), a.alias("at"))), span), lambda s: s.isNotNull())

    there = functools.reduce(operator.or_, (clean.contains(sign) for sign in signs), F.lit(False)) if signs else F.lit(True)
    return F.when(there & F.rlike(clean, F.lit(pattern)), let(pieces, spans)).otherwise(F.array().cast(SPAN))


def find(text: Column) -> Column:
    """Spans (start, order, kind, end) of every rule in a text, by start, then kind as listed.

    The marks that matches are put between are first taken from the text, for a third character that no rule can take
    (one code point each, so places hold).
    """
    marked = text.contains(_OPEN) | text.contains(_CLOSE)
    clean = F.when(marked, F.translate(text, _OPEN + _CLOSE, "\u0003\u0003")).otherwise(text)
    return let(clean, lambda clean: F.array_sort(F.concat(*[_matches(clean, i, *rule) for i, rule in enumerate(RULES)])))


def blob_ids(docs: DataFrame) -> DataFrame:
    """`docs` with blob, the SHA-256 of the text's UTF-8 (null as empty)."""
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION) -> DataFrame:
    """The ledger's new rows: blob, rule_version, spans for each blob of `docs` that `ledger` does not hold under `version`.

    Every version of every path is one row of `docs`; equal contents are scanned once, whoever holds them. Blobs without
    findings are rows with no spans, so they are not scanned again. Append the result to the ledger's table.
    """
    blobs = blob_ids(docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    return blobs.dropDuplicates(["blob"]).select("blob", F.lit(version).alias("rule_version"), find(F.col("text")).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, version: str = RULE_VERSION) -> DataFrame:
    """doc_id, text (and _row of boxed tables), blob and spans from the ledger: all paths of a blob get its findings.

    Rows are never dropped. Only blobs with findings are looked up, each once, however often the ledger holds it; one
    blob may be any share of the rows, which a plain equality join leaves to the adaptive skew split.
    """
    hits = ledger.filter((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    paths = docs.select(*[c for c in ("doc_id", "text", "_row") if c in docs.columns])
    return blob_ids(paths).join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


class Ledger:
    """The ledger's table: Parquet in a folder, partitioned by rule version, that scans append to."""

    SCHEMA = f"blob string, spans {SPAN}, rule_version string"

    def __init__(self, spark: SparkSession, path: str, version: str = RULE_VERSION):
        self.spark, self.path, self.version = spark, path, version

    def rows(self) -> DataFrame:
        """blob, spans, rule_version of all that was scanned so far, under any version."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def update(self, docs: DataFrame) -> Ledger:
        """Scans the blobs of `docs` that are not there under this version, and appends them. The folder is only added to."""
        scan(docs, self.rows(), self.version).write.mode("append").partitionBy("rule_version").parquet(self.path)
        return self

    def findings(self, docs: DataFrame) -> DataFrame:
        return findings(docs, self.rows(), self.version)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """`docs` with every span of every text replaced by `mark`; overlapping spans are one. n_chars (if there) follows.

    Null texts stay null, repeated rows and further columns stay as they are, an empty table gives no rows.
    """
    rows = boxed(docs)
    found = findings(rows, scan(rows))
    text, block = F.col("text"), 1024

    def between(blocks, start, end):
        """Code points from start to end, out of the blocks that hold them: the text is not walked from its beginning."""
        first = F.floor(start / block).cast("int")
        part = F.array_join(F.slice(blocks, first + 1, F.ceil(end / block).cast("int") - first + 1), "")
        return F.substring(part, start - first * block + 1, end - start)

    def cut(blocks):
        ends = F.transform("spans", lambda s: s["end"])
        taken = lambda s, before: F.when(s["start"] >= before, F.concat(between(blocks, before, s["start"]), F.lit(mark))).otherwise(F.lit(""))
        kept = F.zip_with("spans", _before(ends, F.greatest), taken)
        return F.concat(F.array_join(kept, ""), between(blocks, F.array_max(ends), F.length(text)))

    clean = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), cut)
    out = found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(text))
    changed = {"n_chars": F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {}
    return unboxed(out, docs.columns, **changed)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all `documents`, a row for each row, by a ledger that is filled in two deliveries.

    Counts and base_sha256 are of the base kinds, spans has those of all rules.

    First comes about a half of the rows, then the whole table, of which only blobs that the first did not hold are
    scanned; all rows then read the ledger. Null texts are empty; a null doc_id is a row as any other; repeated rows stay;
    further columns play no part; an empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    early = docs.filter(hash_bits(F.col("doc_id"), F.lit("delivery")) < F.lit(1 << 62))
    found = Ledger(spark, scratch_path(spark, "ledger")).update(early).update(docs).findings(docs)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(n, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    """Places of matches from the pieces between them: piece i ends where match i starts."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for order, (kind, pattern, group, least, _) in enumerate(RULES):
        r = quote(pattern)
        parts.append(f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, spot, spot + len(m) AS upto FROM (
  SELECT doc_id, m[i] AS m, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS spot
  FROM (SELECT doc_id, regexp_extract_all(text, {r}) AS m, regexp_split_to_array(text, {r}) AS p FROM d), unnest(range(1, len(m) + 1)) AS u(i)) WHERE len(regexp_extract(m, {r}, {group})) >= {least}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)
    base = ", ".join(f"'{kind}'" for kind in BASE)
    listed = lambda only: f"string_agg(kind || ':' || spot || ':' || upto, ',' ORDER BY spot, o){only}"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {counts}, {listed(f" FILTER (kind IN ({base}))")} AS base, {listed("")} AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


QUERIES = {"op5_secrets": op5_secrets}
ORACLE_SQL = {"op5_secrets": _sql()}
