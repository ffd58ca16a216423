import hashlib
import itertools
import random

from pyspark.sql import functions as F

from larkspur.llm import merkle
from tests.llm.conftest import ROWS


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def roots(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", merkle.root(merkle.tree(F.col("text"))).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_root(spark):
    leaf = lambda *parts: sha("p" + "".join(map(sha, parts)))
    assert roots(spark, ["a\nb\n\nc"])[0] == sha("r" + sha("s" + leaf("a\n") + leaf("b\n") + leaf("\n")) + sha("s" + leaf("c")))
    assert roots(spark, ["", None]) == [sha("r")] * 2
    assert roots(spark, ["or all, in end"])[0] == sha("r" + sha("s" + leaf("or ", "all, ", "in end")))


def test_parts_put_together_are_the_whole(spark):
    texts = [r[1] or "" for r in ROWS] + ["x" * 1000, "一" * 200 + "\n\n \n", "\n\n\na", "a\n \t\n\n\n  b \n", " ", "\r\n\r\nq", "r " * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", merkle._parts(F.col("text"), merkle.SECTION).alias("s"), merkle._parts(F.col("text"), merkle.CHUNK).alias("c"), merkle.chunks(merkle.tree(F.col("text"))).alias("codes"), F.transform(merkle._parts(F.col("text"), merkle.CHUNK), merkle._code).alias("flat")).collect()
    for r in rows:
        assert "".join(r["s"]) == r["text"] == "".join(r["c"]) and r["codes"] == r["flat"]
        assert [v & 127 for v in r["codes"]] == [len(c) for c in r["c"]] and all(0 < len(c) <= 64 for c in r["c"])


def test_unequal_texts_have_unequal_roots(spark):
    """Every string of up to six of these, and random ones of white space."""
    rng = random.Random(4)
    texts = {"".join(t) for n in range(6) for t in itertools.product("a \n", repeat=n)} | {"".join(rng.choices("ab. \n\t\r\u00a0", k=rng.randint(1, 40))) for _ in range(1000)}
    assert len(set(roots(spark, sorted(texts)))) == len(texts)


def diffs(spark, pairs):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, x string, y string").select("i", merkle.tree(F.col("x")).alias("x"), merkle.tree(F.col("y")).alias("y"))
    out = []
    for r in sorted(rows.select("i", merkle.differences(F.col("x"), F.col("y")).alias("d"), merkle.first_difference(F.col("x"), F.col("y")).alias("f")).collect(), key=lambda r: r["i"]):
        out.append([tuple(p) for p in r["d"]])
        assert r["f"] == ("/".join(map(str, out[-1][0])) if out[-1] else "")
    return out


def test_differences(spark):
    a = "one\ntwo\n\nthree\n\nfour"
    expected = {
        (a, a): [],
        ("", ""): [],
        (a, "one\nTWO\n\nthree\n\nfour"): [(0, 1, 0)],
        (a, "one\nTWO\nmore\n\nthree\n\nfour"): [(0, 1, 0), (0, 2, 0), (0, 3, -1)],
        (a, "one\ntwo\n\n"): [(1, -1, -1), (2, -1, -1)],
        ("", "a"): [(0, -1, -1)],
        ("for all, in end", "for one, in end"): [(0, 0, 1)],
        ("a\n\nb", "a\n\n\nb"): [(0, 2, -1)],
    }
    assert diffs(spark, list(expected)) == list(expected.values())


def test_blank_lines_and_indentation_count(spark):
    texts = ["a\n\nb", "a\n\n\nb", "a\n\n\n b", "a\n \n\tb", "a\n\n    b", "a\n\nb\n\n", "a\n\nb\n\n\n", "\n\na\n\nb", "a\nb"]
    assert len(set(roots(spark, texts))) == len(texts) and all(diffs(spark, [(texts[0], t) for t in texts[1:]]))


def test_likeness(spark):
    halves = []
    for text in ("the same line\n" * 60, "word of sand " * 400, "x" * 3000, "一二三四五六七" * 300):
        halves.append((text, text[: len(text) - len(text) // 2] + "".join(chr(0x4E00 + 7 * i % 5000) for i in range(len(text) // 2))))
    moved = " ".join(f"for{i} all{i % 37}, of them{i}." for i in range(300))
    pairs = [("abcd\nefgh", "abcd\nefgh"), ("abc\nefgh", "abc\nzzzz"), ("", ""), ("", "x"), (moved, "An opening that is new. " + moved), *halves]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, x string, y string").select("i", merkle.chunks(merkle.tree(F.col("x"))).alias("x"), merkle.chunks(merkle.tree(F.col("y"))).alias("y"))
    same, half, empty, none, shifted, *kept = [r["n"] for r in sorted(rows.select("i", merkle.likeness(F.col("x"), F.col("y")).alias("n")).collect(), key=lambda r: r["i"])]
    assert (same, half, empty, none) == (1, 0.5, 1, 0) and shifted > 0.9
    assert all(0.4 < n < 0.7 for n in kept)  # repeats, one long line without marks, no blanks at all


def test_next_rows(spark, odd):
    for per_range in (1, 2, 3, 100):
        got = merkle.with_next(odd, per_range).collect()
        order = sorted(((-1 if i is None else i), t or "") for i, t, *_ in ROWS)
        expected = sorted((i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order))
        assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"], r["next_text"]) for r in got) == expected


def test_one_row_and_none(spark, none):
    one = spark.createDataFrame([(5, "abc")], "doc_id long, text string")
    assert merkle.with_next(one).first()["next_text"] == "abc" and merkle.with_next(none).count() == 0


def test_documents(spark, sf_dir, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    ids = sorted(texts)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    rows = merkle.op6_fingerprints(spark, sf_dir).collect()
    by = {}
    for r in rows:
        t, nxt = texts[r["doc_id"]], texts[following[r["doc_id"]]]
        half = len(t) // 2
        assert r["edited_sha256"] == sha(t[: len(t) - half] + nxt[:half]) and r["n_chars"] == len(t)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert len(set(by.values())) == len(by)
    assert sum(r["near_edited"] for r in rows) / len(rows) > 0.45 and sum(r["near_next"] for r in rows) / len(rows) < 0.1
    assert all(r["near_edited"] >= (r["n_chars"] - r["n_chars"] // 2 - 64) / r["n_chars"] for r in rows if r["n_chars"]) and all((r["edited_at"] == "") == (r["fingerprint"] == r["edited_fingerprint"]) for r in rows)
