import numpy as np
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import simhash
from tests.llm.conftest import ROWS


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """id -> smallest id reachable."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_documents(spark, sf_dir, documents):
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in documents.collect()}
    expected = plain_components(fps)
    got = simhash.op4_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", expected[i]) for i in fps}
    kept = {r["doc_id"] for r in simhash.one_of_each(documents).collect()}
    assert kept == set(expected.values())


def test_all_links_at_every_distance(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(64, d, replace=False))) for b in base for d in (1, 2, 3, 4, 5)]
    values = sorted({*map(int, base), *near, 0, 2**64 - 1})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for distance, pieces in ((1, None), (3, None), (4, None), (4, 5), (2, 3)):
        got = [tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in simhash.links(fps, distance, pieces).collect()]
        expected = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin(a ^ b).count("1") <= distance}
        assert len(got) == len(set(got)) and set(got) == expected


def test_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(-40, 60)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r["vertex"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: -40 for i in range(-40, 61)} | {i: 100 for i in (100, 101, 102)}


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64) for r in rows) == sorted((str(r[0]), plain_fingerprint(r[1])) for r in ROWS)
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 5)} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "6", "7", "8", "9", "None"]
    assert kept.filter(F.col("doc_id") == 7).count() == 1


def test_an_id_that_comes_again_with_another_text(spark):
    a, b = "one two three four five six seven", "quite another text that shares no words with it"
    rows = lambda docs: sorted((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect())
    make = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    assert rows(make((1, a), (2, b), (2, a))) == [(1, a), (2, b)]
    assert rows(make((1, a), (1, b), (1, a), (2, b))) == [(1, a), (1, b)]
    assert rows(make((2, a), (2, a), (2, a + " "), (3, a))) in ([(2, a)], [(2, a + " ")])
    assert len(simhash.one_of_each(make((None, a), (None, a), (5, a))).collect()) == 3


def test_nothing_is_broadcast(spark, documents, monkeypatch):
    """Tables that grow with the documents never go through the driver, however small they look."""
    plans, write = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, label: plans.append(df) or write(df, label))
    plans += [simhash.near_duplicates(documents), simhash.one_of_each(documents)]
    for df in plans:
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
