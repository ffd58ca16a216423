"""Operator 6: document fingerprints as Merkle trees over sections, paragraphs and chunks (built-in functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import let, read_table

#: Parts that put together are the whole again: sections end with blank lines, paragraphs with a newline, chunks after a
#: blank that follows one of these letters or marks, at the paragraph's end, or after 64 characters.
SECTION, PARAGRAPH = r"[\s\S]+?(?:\n[ \t\n]*\n|\z)", r"[^\n]*\n|[^\n]+"
CHUNK = r"[^\n]{1,62}?(?:[dglry0-9.!?,;:][ \t]|\n|\z)|\n|[^\n]{1,64}"
#: Chunks have at most 64 characters: seven bits of a code say how many.
_LENGTH = 127


def digest(part: Column) -> Column:
    return F.sha2(part.cast("binary"), 256)


def _node(level: str, children: Column) -> Column:
    """The digest of an inner node: its level, then its children's digests."""
    return digest(F.concat(F.lit(level), F.array_join(children, "")))


def _parts(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _code(chunk: Column) -> Column:
    """56 bits of the chunk's hash over its length, never negative."""
    return F.xxhash64(chunk).bitwiseAND(F.lit(((1 << 63) - 1) & ~_LENGTH)).bitwiseOR(F.length(chunk).cast("long"))


def tree(text: Column) -> Column:
    """Sections of paragraphs of chunks: array of (digest, paragraphs: array of (digest, chunks: array of codes)).

    A chunk's digest is that of its characters, an inner node's that of its children's digests, tagged by level. All
    characters are in chunks, so equal digests mean equal texts, white space and blank lines included. A null text is
    empty: no sections.
    """

    def paragraph(p):
        node = lambda chunks: F.struct(_node("p", F.transform(chunks, digest)).alias("digest"), F.transform(chunks, _code).alias("chunks"))
        return let(_parts(p, CHUNK), node)

    def section(s):
        return F.transform(_parts(s, PARAGRAPH), paragraph)

    def node(paragraphs):
        return F.struct(_node("s", F.transform(paragraphs, lambda p: p["digest"])).alias("digest"), paragraphs.alias("paragraphs"))

    return F.transform(F.transform(_parts(F.coalesce(text, F.lit("")), SECTION), section), node)


def root(tree: Column) -> Column:
    """The fingerprint: the digest of a tree's sections."""
    return _node("r", F.transform(tree, lambda s: s["digest"]))


def chunks(tree: Column) -> Column:
    """The codes of a tree's chunks, in their order."""
    return F.flatten(F.flatten(F.transform(tree, lambda s: F.transform(s["paragraphs"], lambda p: p["chunks"]))))


def likeness(a: Column, b: Column) -> Column:
    """Share (0 to 1) of two trees' chunks, by length, that both have; two trees without any are alike.

    Chunks at equal places are compared first, repeats included; of the others, each kind counts once, wherever it stands.
    """
    weight = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, v: n + v.bitwiseAND(F.lit(_LENGTH)))
    rest = lambda x, y: F.array_distinct(F.filter(x, lambda v, i: ~v.eqNullSafe(F.get(y, i))))
    placed = weight(F.filter(a, lambda v, i: v.eqNullSafe(F.get(b, i))))
    one, other = rest(a, b), rest(b, a)
    total = 2 * placed + weight(one) + weight(other)
    return F.when(total > 0, 2.0 * (placed + weight(F.array_intersect(one, other))) / total).otherwise(F.lit(1.0))


def differences(a: Column, b: Column) -> Column:
    """Where two trees differ: array of (section, paragraph, chunk), found by going down unequal branches only; -1 for a whole
    section or paragraph that only one of them has."""
    spots = lambda x, y: F.when(F.greatest(F.size(x), F.size(y)) > 0, F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda s, p, c: F.struct(s.alias("section"), p.alias("paragraph"), c.alias("chunk"))
    whole = F.lit(-1)

    def in_paragraph(x, y, s, p):
        unlike = F.filter(spots(x, y), lambda c: ~F.get(x, c).eqNullSafe(F.get(y, c)))
        return F.when(x.isNull() | y.isNull(), F.array(one(s, p, whole))).otherwise(F.transform(unlike, lambda c: one(s, p, c)))

    def in_section(x, y, s):
        unlike = F.filter(spots(x, y), lambda p: ~F.get(x, p)["digest"].eqNullSafe(F.get(y, p)["digest"]))
        below = F.flatten(F.transform(unlike, lambda p: in_paragraph(F.get(x, p)["chunks"], F.get(y, p)["chunks"], s, p)))
        return F.when(x.isNull() | y.isNull(), F.array(one(s, whole, whole))).otherwise(below)

    branches = F.filter(spots(a, b), lambda s: ~F.get(a, s)["digest"].eqNullSafe(F.get(b, s)["digest"]))
    return F.flatten(F.transform(branches, lambda s: in_section(F.get(a, s)["paragraphs"], F.get(b, s)["paragraphs"], s)))


def first_difference(a: Column, b: Column) -> Column:
    """The first of `differences` as "section/paragraph/chunk", '' if there is none; one branch a level is looked at."""
    unlike = lambda x, y, of: F.coalesce(F.get(F.filter(F.transform(x, lambda v, i: F.when(of(v).eqNullSafe(of(F.get(y, i))), F.lit(-1)).otherwise(i)), lambda i: i >= 0), F.lit(0)), F.when(F.size(y) > F.size(x), F.size(x)))
    node, self_ = lambda v: v["digest"], lambda v: v
    s = unlike(a, b, node)
    x, y = F.get(a, s)["paragraphs"], F.get(b, s)["paragraphs"]
    p = F.when(x.isNull() | y.isNull(), F.lit(-1)).otherwise(unlike(x, y, node))
    u, v = F.get(x, p)["chunks"], F.get(y, p)["chunks"]
    c = F.when((p < 0) | u.isNull() | v.isNull(), F.lit(-1)).otherwise(unlike(u, v, self_))
    return F.when(s.isNull(), F.lit("")).otherwise(F.concat_ws("/", s, p, c))


MOST_RANGES = 8192


def _range_of(key: Column, starts: list[int]) -> Column:
    """Which of the ascending range starts (the first is the least key) holds a key; found in two steps of about sqrt(n)."""
    wide = max(1, math.isqrt(len(starts)))
    groups = [starts[i : i + wide] for i in range(0, len(starts), wide)]
    below = lambda xs: F.size(F.filter(xs, lambda e: e <= key)) - 1
    group = below(F.array(*[F.lit(g[0]) for g in groups]))
    return group * wide + below(F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), group))


def with_next(docs: DataFrame, rows_per_range: int = 5_000) -> DataFrame:
    """doc_id, text, next_text: the text of the next row by doc_id (nulls first, ties by text), after the last the first.

    Rows are dealt by ranges of doc_id whose starts are quantiles, thus keys that occur; rows that hold a range's first
    key go to the range before it as well (those of the least key to the last range, behind all others), so that one
    window in each range finds every successor and texts are shuffled once. Equal doc_ids share a range. There are at
    most MOST_RANGES ranges, whose starts are part of the plan; beyond, ranges have more rows and their sorts may spill.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_k"))
    n, least = rows.agg(F.count(F.lit(1)), F.min("_k")).first()
    ranges = min(MOST_RANGES, max(1, math.ceil(n / rows_per_range)))
    cuts = rows.agg(F.percentile_approx("_k", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else []
    starts = sorted({least or 0, *cuts})
    at = F.col("_at")
    first = F.col("_k") == F.get(F.array(*map(F.lit, starts)), at)
    spot = lambda r, wrap, shadow: F.struct(r.alias("_r"), F.lit(wrap).alias("_wrap"), F.lit(shadow).alias("_shadow"))
    shadow = F.when(at > 0, spot(at - 1, 0, True)).otherwise(spot(F.lit(len(starts) - 1), 1, True))
    dealt = rows.withColumn("_at", _range_of(F.col("_k"), starts)).select("doc_id", "text", "_k", F.inline(F.when(first, F.array(spot(at, 0, False), shadow)).otherwise(F.array(spot(at, 0, False)))))
    order = Window.partitionBy("_r").orderBy("_wrap", "_k", "text", "_shadow")
    return dealt.withColumn("next_text", F.lead("text").over(order)).filter(~F.col("_shadow")).select("doc_id", "text", "next_text")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses of all `documents`, their edited texts and the next documents, a row for each row.

    Fingerprints are roots of the trees, likenesses those of the same trees' chunks; `edited_at` is the first place where
    the edited text's tree differs ('' if nowhere). Null texts are empty and like each other; rows go by doc_id (it must
    cast to long), nulls first, ties by text, so repeated rows follow each other; the only row is followed by itself;
    further columns play no part; an empty table gives no rows.
    """
    pairs = with_next(read_table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    trees = edited.select("doc_id", "n_chars", digest(F.col("edited")).alias("edited_sha256"), tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("new"), F.transform(_parts(F.col("next_text"), CHUNK), _code).alias("next"))
    told = trees.select("doc_id", "n_chars", "edited_sha256", root(F.col("own")).alias("fingerprint"), root(F.col("new")).alias("edited_fingerprint"), chunks(F.col("own")).alias("own_chunks"), chunks(F.col("new")).alias("new_chunks"), "next", first_difference(F.col("own"), F.col("new")).alias("edited_at"))
    return told.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own_chunks"), F.col("new_chunks")).alias("near_edited"), likeness(F.col("own_chunks"), F.col("next")).alias("near_next"), "edited_at")


#: Written by hand; chunks are compared as texts, not by code, and places by whole lists.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS nxt FROM d),
e AS (SELECT doc_id, text, nxt, left(text, len(text) - len(text) // 2) || left(nxt, len(text) // 2) AS edited FROM n),
every AS (SELECT DISTINCT unnest([text, nxt, edited]) AS body FROM e),
sections AS (SELECT body, unnest(list_transform(regexp_extract_all(body, '[\s\S]+?(?:
[ 	
]*
|\z)'), lambda s: list_transform(regexp_extract_all(s, '[^
]*
|[^
]+'), lambda p: regexp_extract_all(p, '[^
]{1,62}?(?:[dglry0-9.!?,;:][ 	]|
|\z)|
|[^
]{1,64}')))) AS paragraphs, generate_subscripts(regexp_extract_all(body, '[\s\S]+?(?:
[ 	
]*
|\z)'), 1) AS place FROM every),
digests AS (SELECT body, place, paragraphs, list_transform(paragraphs, lambda p: sha256('p' || coalesce(list_aggregate(list_transform(p, lambda c: sha256(c)), 'string_agg', ''), ''))) AS told FROM sections),
roots AS (SELECT body, sha256('r' || string_agg(sha256('s' || list_aggregate(told, 'string_agg', '')), '' ORDER BY place)) AS root, list(told ORDER BY place) AS told, list(paragraphs ORDER BY place) AS paragraphs FROM digests GROUP BY body),
trees AS (SELECT every.body, coalesce(root, sha256('r')) AS root, coalesce(told, []) AS told, coalesce(paragraphs, []) AS paragraphs, coalesce(flatten(flatten(paragraphs)), []) AS chunks FROM every LEFT JOIN roots USING (body)),
j AS (SELECT doc_id, len(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, t.root AS fingerprint, u.root AS edited_fingerprint, t.told AS told, u.told AS told_e, t.paragraphs AS pars, u.paragraphs AS pars_e, t.chunks AS a, u.chunks AS b, v.chunks AS c FROM e JOIN trees t ON t.body = e.text JOIN trees u ON u.body = e.edited JOIN trees v ON v.body = e.nxt),
k AS (SELECT *, list_filter(range(1, greatest(len(told), len(told_e)) + 1), lambda i: told[i] IS DISTINCT FROM told_e[i])[1] AS s FROM j),
l AS (SELECT *, CASE WHEN s IS NULL THEN NULL WHEN s > least(len(told), len(told_e)) THEN 0 ELSE list_filter(range(1, greatest(len(told[s]), len(told_e[s])) + 1), lambda i: told[s][i] IS DISTINCT FROM told_e[s][i])[1] END AS p FROM k),
m AS (SELECT *, CASE WHEN s IS NULL THEN NULL WHEN p = 0 OR p > least(len(told[s]), len(told_e[s])) THEN 0 ELSE list_filter(range(1, greatest(len(pars[s][p]), len(pars_e[s][p])) + 1), lambda i: pars[s][p][i] IS DISTINCT FROM pars_e[s][p][i])[1] END AS q FROM l),
x AS (SELECT *,
  list_filter(a, lambda z, i: z IS NOT DISTINCT FROM b[i]) AS ab, list_distinct(list_filter(a, lambda z, i: z IS DISTINCT FROM b[i])) AS a_b, list_distinct(list_filter(b, lambda z, i: z IS DISTINCT FROM a[i])) AS b_a,
  list_filter(a, lambda z, i: z IS NOT DISTINCT FROM c[i]) AS ac, list_distinct(list_filter(a, lambda z, i: z IS DISTINCT FROM c[i])) AS a_c, list_distinct(list_filter(c, lambda z, i: z IS DISTINCT FROM a[i])) AS c_a FROM m),
w AS (SELECT *, len(array_to_string(ab, '')) AS w_ab, len(array_to_string(a_b, '')) + len(array_to_string(b_a, '')) AS o_ab, len(array_to_string(list_intersect(a_b, b_a), '')) AS i_ab,
  len(array_to_string(ac, '')) AS w_ac, len(array_to_string(a_c, '')) + len(array_to_string(c_a, '')) AS o_ac, len(array_to_string(list_intersect(a_c, c_a), '')) AS i_ac FROM x)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN 2 * w_ab + o_ab > 0 THEN 2.0::DOUBLE * (w_ab + i_ab) / (2 * w_ab + o_ab) ELSE 1.0::DOUBLE END AS near_edited,
  CASE WHEN 2 * w_ac + o_ac > 0 THEN 2.0::DOUBLE * (w_ac + i_ac) / (2 * w_ac + o_ac) ELSE 1.0::DOUBLE END AS near_next,
  CASE WHEN s IS NULL THEN '' ELSE (s - 1) || '/' || (p - 1) || '/' || (q - 1) END AS edited_at FROM w"""

QUERIES = {"op6_fingerprints": op6_fingerprints}
ORACLE_SQL = {"op6_fingerprints": SQL}
