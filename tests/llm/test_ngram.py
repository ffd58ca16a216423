import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import files, ngram
from tests.llm.conftest import ROWS


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        counts = [None] * (order + 1)
        counts[order] = Counter()
        self.raw = Counter()
        for t in texts:
            line = self.line(t)
            self.raw.update(line[order - 1 :])
            counts[order].update(tuple(line[i - order + 1 : i + 1]) for i in range(order - 1, len(line)))
        for k in range(order - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        self.counts, self.discounts, self.contexts = counts, [None], [None]
        for k in range(1, order + 1):
            n1, n2, n3, n4 = (sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ds = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            self.discounts.append([0, *(min(max(d, 0.1), c - 0.05) for c, d in enumerate(ds, 1))])
            sums = defaultdict(lambda: [0, 0.0])
            for g, c in counts[k].items():
                sums[g[:-1]][0] += c
                sums[g[:-1]][1] += self.discounts[k][min(c, 3)]
            self.contexts.append(dict(sums))

    def line(self, text):
        return ["<s>"] * (self.order - 1) + (text or "").encode().lower().split() + ["</s>"]

    def probability(self, gram):
        """Interpolated down to the uniform share of all words and one unknown."""
        p = 1 / (len(self.raw) + 1)
        for k in range(1, self.order + 1):
            g = gram[len(gram) - k :]
            total, kept = self.contexts[k].get(g[:-1], (0, 0.0))
            if total:
                c = self.counts[k].get(g, 0)
                p = (c - self.discounts[k][min(c, 3)]) / total + kept / total * p
        return p

    def score(self, text):
        line = self.line(text)
        return sum(math.log10(self.probability(tuple(line[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(line)))


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_those_of_the_formula(spark, documents, order):
    docs = documents.filter("doc_id < 120").select("doc_id", "text")
    train = docs.filter("doc_id % 4 <> 0")
    model = ngram.train(train.select("text"), order)
    plain = Plain([r["text"] for r in train.collect()], order)
    assert (model.vocabulary.tokens, len(model.vocabulary)) == (sum(plain.raw.values()), len(plain.raw))
    for r in ngram.score(docs, model).join(docs, "doc_id").collect():
        assert r["score"] == pytest.approx(plain.score(r["text"]), rel=1e-9)
        line = plain.line(r["text"])[order - 1 :]
        base = sum(math.log10((plain.raw[w] + 0.5) / (model.vocabulary.tokens + 0.5 * (len(model.vocabulary) + 1))) for w in line)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["n_tokens"] == len(line) and r["n_known"] == sum(w in plain.raw for w in line)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "a b d", "b c", "", "c c c c"]
    plain = Plain(texts, 2)
    assert sum(plain.probability(("a".encode(), w)) for w in [*plain.raw, b"unknown"]) == pytest.approx(1)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_many_shards_and_hot_contexts(spark, documents, monkeypatch, order):
    monkeypatch.setattr(ngram, "SHARD_BYTES", 3000)
    monkeypatch.setattr(ngram, "LAYOUT_SAMPLE", 1)
    docs = documents.filter("doc_id < 60").select("doc_id", "text")
    model = ngram.train(docs.select("text"), order)
    assert model.layout.bits > 3 and len(model.layout.hot[0]) > 0 and len(model.hot[0]) == len(model.layout.hot[0])
    plain = Plain([r["text"] for r in docs.collect()], order)
    for r in ngram.score(docs, model).join(docs, "doc_id").collect():
        assert r["score"] == pytest.approx(plain.score(r["text"]), rel=1e-9)


def test_small_numbers_and_rows_of_many_kinds():
    values = np.array([0, 1, 254, 255, 256, 10**12])
    assert ngram._Reader(b"".join(ngram._small(values))).small(6).tolist() == values.tolist()
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, most, 20_000) for most in (200, 70_000, 1 << 40)]
    got, sums = ngram._unpack([ngram._pack([c[:9] for c in columns], np.arange(9)), ngram._pack([c[9:] for c in columns], np.arange(9, 20_000))], 3)
    assert all((a == b).all() for a, b in zip(got, columns)) and (sums == np.arange(20_000)).all()
    # more columns than one long can hold
    wide = [rng.integers(0, 3, 500) for _ in range(3)]
    rows, sums = ngram._sorted(wide, 1 << 30)
    assert Counter(zip(*map(np.ndarray.tolist, wide))) == dict(zip(zip(*map(np.ndarray.tolist, rows)), sums.tolist()))
    assert list(zip(*map(np.ndarray.tolist, rows))) == sorted(zip(*map(np.ndarray.tolist, rows)))


def test_tables_hold_what_they_were_given(tmp_path):
    rng = np.random.default_rng(2)
    for n in (0, 1, 17, 5000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        values = rng.integers(0, 1000, (n, 2))
        files.write_file(f"file://{tmp_path}/{n}", ngram._table(keys, values))
        asked = np.concatenate([keys, rng.integers(0, 1 << 63, 50).astype(np.uint64)])
        out = np.zeros((len(asked), 2), np.int64)
        ngram._find(f"file://{tmp_path}/{n}", asked, out, np.arange(len(asked)))
        assert (out[:n] == values).all() and not out[n:].any()


def test_the_query_is_the_plain_model(spark, sf_dir, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    plain = Plain([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1], 3)
    for r in ngram.op8_ngram(spark, sf_dir).collect():
        assert r["score"] == pytest.approx(plain.score(texts[r["doc_id"]]), rel=1e-9) and r["train_tokens"] == sum(plain.raw.values())


def test_held_out_documents(spark, sf_dir, documents):
    rows = ngram.op8_ngram(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows) and len(rows) == documents.count()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_tokens_are_byte_words(spark):
    texts = [r[1] for r in ROWS] + ["A\x0bB\x0cC\rd e f", "İÄ \x1c \x85"]
    t = ngram.Tokens.of(pa.array(texts, pa.string()), 2)
    assert t.counts.tolist() == [len((x or "").encode().lower().split()) + 1 for x in texts] and t.counts.sum() == len(t.places)


def test_odd_rows(odd, none):
    model = ngram.train(odd.select("text"))
    plain = Plain([r[1] for r in ROWS], 3)
    got = ngram.score(odd, model).collect()
    assert sorted(round(r["score"], 6) for r in got) == sorted(round(plain.score(r[1]), 6) for r in ROWS)
    empty = ngram.train(none.select("text"))
    assert ngram.score(none, model).count() == 0 and empty.vocabulary.tokens == 0
    assert all(math.isfinite(r["score"]) for r in ngram.score(odd.filter(F.col("doc_id") == 1), empty).collect())


def test_files_are_whole(tmp_path):
    uri = f"file://{tmp_path}/a/b"
    files.write_file(uri, b"12345")
    assert bytes(files.map_file(uri)) == b"12345" and files.map_file(uri + "x") is None and [p.name for p in (tmp_path / "a").iterdir()] == ["b"]
