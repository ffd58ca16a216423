import os
import random
import unicodedata

import numpy as np
import pytest

from larkspur.llm import language
from larkspur.llm.language import BUCKETS, Model, subwords
from tests.llm.conftest import ROWS


def plain(text):
    """Counts of buckets, subword by subword."""
    words, now = [], ""
    for c in text.lower():
        if unicodedata.category(c)[0] in "LM":
            now += c
        elif now:
            words, now = words + [now], ""
    words += [now] if now else []
    out = np.zeros(BUCKETS, np.int64)
    spots = 2**32
    for word in words:
        points = [0, *map(ord, word), 0]
        codes = []
        for n in (2, 3, 4):
            for k in range(len(points) - n + 1):
                code = points[k]
                for p in points[k + 1 : k + n]:
                    code = (code * 0x01000193 + p) % spots
                codes.append(code * (2 * n + 1) % spots)
        codes.append(sum(p * pow(0x5BD1E995, k + 1, spots) for k, p in enumerate(points[1:-1])) % spots)
        for code in codes:
            out[((code ^ code >> 15) * 0x9E3779B1 % spots) >> 18] += 1
    return out


TEXTS = ["", "  ", "a", "Ab cd", "éß naïve ünï 𝔘𝔫𝔦 x", "1234 !? ́", "कि हिन्दी", "don't stop-me_now", "İstanbul", " lead and trail ", "a\u0000b\ud800c"]


@pytest.mark.parametrize("text", TEXTS)
def test_subwords_equal_plain_counts(text):
    counts, letters = subwords(text)
    assert counts.tolist() == plain(text).tolist()
    assert letters == any(c.isalpha() for c in text)


def test_long_texts_go_window_by_window(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    whole = subwords(text)[0]
    monkeypatch.setattr(language, "WINDOW", 100)
    assert (subwords(text)[0] == whole).all()
    assert subwords("x" * 1000)[1] and subwords(" " * 1000)[0].sum() == 0


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    make = lambda: Model(["a", "b", "c"], np.zeros((BUCKETS, 16), np.float32), np.random.default_rng(3).standard_normal((16, 3)), np.zeros(3))
    at = np.array([5, 7, 100])
    share = np.array([0.5, 0.25, 0.25], np.float32)
    start, moved = make(), make()
    start.embeddings[at] = moved.embeddings[at] = rng.standard_normal((3, 16)).astype(np.float32)
    language.descend(moved, [(at, share)], np.array([1]), 1, 1e-3, 0)

    def loss(weights, bias, rows):
        return -np.log(language.softmax(share @ rows @ weights + bias)[1])

    rows = start.embeddings[at].astype(np.float64)
    step = 1e-5
    for i, j in [(0, 0), (3, 1), (15, 2)]:
        up, down = start.weights.copy(), start.weights.copy()
        up[i, j] += step
        down[i, j] -= step
        slope = (loss(up, start.bias, rows) - loss(down, start.bias, rows)) / (2 * step)
        assert abs((start.weights - moved.weights)[i, j] / 1e-3 - slope) < 1e-4
    for i, j in [(0, 0), (1, 7), (2, 15)]:
        up, down = rows.copy(), rows.copy()
        up[i, j] += step
        down[i, j] -= step
        slope = (loss(start.weights, start.bias, up) - loss(start.weights, start.bias, down)) / (2 * step)
        assert abs((rows - moved.embeddings[at])[i, j] / (1e-3 / float(share @ share)) - slope) < 1e-3


def test_calibration_accepts_what_is_wrong_no_oftener_than_told():
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 2, 4000)
    counts = np.zeros((4000, BUCKETS), np.float32)
    counts[np.arange(4000), labels] = 1 + rng.uniform(0, 3, 4000)
    counts[np.arange(4000), 1 - labels] = rng.uniform(0, 2, 4000)
    model = Model(["a", "b"], np.zeros((BUCKETS, 16), np.float32), np.eye(16, 2) * 20.0, np.zeros(2))
    model.embeddings[0, 0] = model.embeddings[1, 1] = 1.0
    texts = [language.shares(c) for c in counts]
    new, true = texts[2000:], labels[2000:]
    loss = lambda: -np.log(model.probabilities(new)[np.arange(2000), true]).mean()
    before = loss()
    language.calibrate(model, texts[:2000], labels[:2000], 0.02)
    assert loss() < before and model.temperature > 1
    p = model.probabilities(new)
    wrong, accepted = p.argmax(1) != true, p.max(1) >= model.threshold
    assert wrong.mean() > 0.05 and wrong[accepted].mean() < 0.03 and accepted.mean() > 0.5
    language.calibrate(model, texts[:40], labels[:40], 0.02)
    assert model.threshold == np.inf  # 40 texts cannot show that


def test_query_is_right_on_the_held_out_fold(spark):
    from zlib import crc32

    table = "/root/testdata/sf0.01"
    got = language.op12_language(spark, table)
    assert [f"{c} {t}" for c, t in got.dtypes] == ["doc_id bigint", "held_out boolean", "lang_pred string", "score double", "accepted boolean"]
    rows = got.collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "lang").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(langs)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.985
    assert np.mean([r["accepted"] for r in held]) > 0.9
    assert {tuple(r) for r in language.op12_language(spark, table).collect()} == set(map(tuple, rows))


def test_short_pieces_and_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs.filter(~language.held_out("doc_id")))
    rng = random.Random(7)
    rows = docs.filter(language.held_out("doc_id")).collect()
    pieces = []
    for r in rows:
        words = r["text"].split()
        at = rng.randrange(max(1, len(words) - 15))
        pieces.append((r["doc_id"], " ".join(words[at : at + 15])))
    langs = {r["doc_id"]: r["lang"] for r in rows}
    got = language.identify(spark.createDataFrame(pieces, "doc_id long, text string"), model).collect()
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got]) > 0.95
    noise = [(k, " ".join("".join(rng.choice("qwxzkjvyπжя") for _ in range(rng.randrange(1, 9))) for _ in range(30))) for k in range(100)]
    unsure = language.identify(spark.createDataFrame(noise, "doc_id long, text string"), model).collect()
    assert np.mean([r["score"] for r in unsure]) < np.mean([r["score"] for r in got]) - 0.1
    assert np.mean([r["accepted"] for r in unsure]) < np.mean([r["accepted"] for r in got]) - 0.3


def test_odd_rows_and_nothing_to_learn(spark, odd, none, tmp_path):
    docs = odd.repartition(3)
    docs.write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = language.op12_language(spark, str(tmp_path)).collect()
    key = lambda k: (k is not None, k or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in ROWS), key=key)
    assert {(r["lang_pred"], r["score"], r["accepted"]) for r in got if r["doc_id"] in (3, 4, 5)} == {("und", 0.0, False)}
    assert {r["lang_pred"] for r in got if r["doc_id"] not in (3, 4, 5)} <= {"en", "de", "fr"}
    empty = language.train(none)
    assert empty.languages == [] and language.identify(none, empty).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in language.identify(odd, empty).collect()} == {("und", 0.0)}


def test_more_languages_than_the_sample_has_rows(spark):
    rows = [(f"word{i} {'abc'[i % 3] * 5} text", f"l{i:03d}") for i in range(60)] + [(f"common words {i}", "often") for i in range(40)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), sample=10)
    assert len(model.languages) == 10 and "often" in model.languages
