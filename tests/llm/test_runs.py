import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from larkspur.llm import runs
from tests.llm.conftest import EXTRA, ROWS


def plain(words, least=6, exponent=4):
    """All maximal runs, period by period, of which only those with no smaller period count."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            to = i
            while to + q < n and words[to] == words[to + q]:
                to += 1
            start, length = i, to + q - i
            smallest = next(d for d in range(1, q + 1) if all(words[k] == words[k + d] for k in range(start, start + length - d)))
            if smallest == q and length >= max(least, exponent * q):
                out.append((start, length, q))
            i = to
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def of(sequences, **params):
    got, texts = runs._group([[str(w).encode() for w in s] for s in sequences], params.get("least", 6), params.get("exponent", 4))
    return [[(r["start"], r["length"], r["period"]) for r in own] for own in got.to_pylist()], [t.decode() for t in texts]


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_of_many_sequences_equal_plain_search(letters):
    rng = random.Random(letters)
    sequences = [[], [0], [0] * 5, [0] * 6, [0, 1] * 4, [0, 1] * 4 + [0], [2] + [0, 1] * 9 + [1] * 9]
    for _ in range(250):
        s = [rng.randrange(letters) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            root = [rng.randrange(letters) for _ in range(rng.randrange(1, 8))]
            cut = rng.randrange(len(root))
            s += root * rng.randrange(1, 9) + root[:cut]
        sequences.append(s)
    found, texts = of(sequences)
    for s, own, text in zip(sequences, found, texts):
        words = list(map(str, s))
        assert own == plain(words)
        assert text == collapse(words, own)


@pytest.mark.parametrize(("least", "exponent"), [(1, 2), (4, 2), (2, 3), (20, 5)])
def test_other_lengths_and_exponents(least, exponent):
    rng = random.Random(5)
    sequences = [[rng.randrange(2) for _ in range(rng.randrange(60))] for _ in range(150)]
    found, _ = of(sequences, least=least, exponent=exponent)
    assert found == [plain(s, least, exponent) for s in sequences]


def test_next_smaller_and_shared_prefixes():
    rng = np.random.default_rng(1)
    values = rng.permutation(3000)
    expected = [next((k for k in range(i + 1, 3000) if values[k] < v), 3000) for i, v in enumerate(values)]
    assert runs.next_smaller(values).tolist() == expected
    assert runs.next_smaller(np.arange(100)).tolist() == [100] * 100
    ids = np.concatenate([1 + rng.integers(0, 2, 400), [0]])
    index = runs.SuffixIndex(ids)
    order = sorted(range(401), key=lambda i: ids[i:].tolist())
    assert index.suffixes.tolist() == order
    a, b = rng.integers(0, 400, 500), rng.integers(0, 400, 500)
    a, b = a[a != b], b[a != b]
    for i, j, got in zip(a, b, index.shared(a, b)):
        assert got == next(k for k in range(401) if ids[i + k] != ids[j + k])


def test_long_texts_and_groups(monkeypatch):
    million = [0, 1, 2] * 333_333
    found, texts = of([million, [5] * 1_000_000, list(range(200_000))])
    assert found == [[(0, 999_999, 3)], [(0, 1_000_000, 1)], []]
    assert texts[:2] == ["0 1 2", "5"]


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    if words and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_by_hash(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha(lines), sha(collapse(words, found)))


def plain_by_hash(words):
    """`plain` for whole documents: stretches of equal words q apart from one array comparison a period."""
    numbers = {}
    ids, out = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), []
    for q in range(1, len(ids) // 4 + 1):
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = e - s + q
            part = ids[s : s + length]
            if length >= max(6, 4 * q) and not any(q % d == 0 and (part[:-d] == part[d:]).all() for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_query_equals_plain_search_on_all_documents(spark, sf_dir):
    got = runs.op11_runs(spark, sf_dir)
    assert [f"{c} {t}" for c, t in got.dtypes] == ["doc_id bigint", "n_runs bigint", "start bigint", "length bigint", "period bigint", "exponent_milli bigint", "runs_sha256 string", "collapsed_sha256 string"]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(map(tuple, got.collect())) == sorted(expected(r["doc_id"], r["text"]) for r in rows)


def test_odd_rows_and_empty_table(spark, odd, none, tmp_path):
    more = spark.createDataFrame([(20, "a b c\x0b" * 40 + "x", None, None, None), (30, "e " * 7, None, None, None), (41, " " * 9, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd.unionByName(more, allowMissingColumns=True)
    docs.write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = runs.op11_runs(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, str(r))
    rows = [(r[0], r[1]) for r in ROWS] + [(r["doc_id"], r["text"]) for r in more.collect()]
    assert sorted(map(tuple, got), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert EXTRA
    assert runs.periodic_runs(none).count() == 0
    sha = hashlib.sha256(b"").hexdigest()
    assert {r["collapsed_sha256"] for r in got if r["doc_id"] in (3, 4, 5)} == {sha}
