"""Operator 12: language identification by averaged hashed subword embeddings with a linear softmax and calibrated rejection."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import hash_bits, read_table, small_batches

#: Hashed subwords, and the width of their embeddings.
BUCKETS, WIDTH = 1 << 14, 16
#: Characters that are hashed at once; longer texts go window by window.
WINDOW = 1 << 20
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for a mark (part of a word, but no letter by itself), else 0."""
    kinds = {"L": 1, "M": 2}
    return np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def _windows(text: str) -> Iterator[str]:
    """The whole text in windows, cut after a blank where there is one."""
    at = 0
    while at < len(text):
        to = min(len(text), at + WINDOW)
        if to < len(text):
            to = text.rfind(" ", at, to) + 1 or to
        yield text[at:to]
        at = to


def subwords(text: str) -> tuple[np.ndarray, bool]:
    """How often each bucket occurs over the whole text, and whether it has a letter.

    Words are runs of letters and marks, in lower case, with a boundary at both ends. Their subwords are all stretches of
    two to four characters, boundaries included, and the word itself.
    """
    counts, letters = np.zeros(BUCKETS, np.int64), False
    factor, spread = np.uint32(0x01000193), np.uint32(0x9E3779B1)
    for window in _windows(text):
        points = np.frombuffer(window.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _kinds()[points]
        inside = kind > 0
        letters = letters or bool((kind == 1).any())
        keep = inside.copy()
        keep[1:] |= inside[:-1]  # one boundary after each word
        word = np.zeros(int(keep.sum()) + 2, np.uint32)
        word[1:-1] = np.where(inside, points, 0)[keep]
        if len(word) < 3:
            continue
        word = word if word[-2] else word[:-1]
        grams, valid = word, None
        found = []
        for n in (2, 3, 4):
            grams = grams[:-1] * factor + word[n - 1 :]
            if n > 2:  # nothing but the ends may be a boundary
                valid = word[1:-1] != 0 if valid is None else valid[:-1] & (word[2:-1] != 0)
            found.append((grams if valid is None else grams[valid]) * np.uint32(2 * n + 1))
        starts = np.flatnonzero((word[1:] != 0) & (word[:-1] == 0)) + 1
        place = np.arange(len(word)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(word)]])))
        powers = np.cumprod(np.full(int(place.max()) + 1, 0x5BD1E995, np.uint32), dtype=np.uint32)
        found.append(np.add.reduceat(word * powers[place], starts, dtype=np.uint32))
        codes = np.concatenate(found)
        codes ^= codes >> np.uint32(15)
        counts += np.bincount((codes * spread) >> np.uint32(18), minlength=BUCKETS)
    return counts, letters


def _piece(text: str, seed: int) -> str:
    """Some of a text's words, so that short texts are learned from as well: 2 to 25 in a row."""
    words = text.split()
    size = 2 + seed % 24
    at = (seed >> 8) % max(1, len(words) - size + 1)
    return " ".join(words[at : at + size])


@dataclass
class Model:
    """Languages with embeddings of buckets, a linear softmax, its temperature and the score from which it is sure."""

    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = np.inf

    def logits(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of texts as buckets and their shares; one without any has the bias alone."""
        mean = np.stack([share @ self.embeddings[at] for at, share in texts]) if texts else np.zeros((0, WIDTH))
        return mean.astype(np.float64) @ self.weights + self.bias

    def probabilities(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur, and what part of all each is."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), (counts[at] / max(1, counts.sum())).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def descend(model: Model, examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, rate: float, seed: int) -> None:
    """Stochastic gradient descent on the cross-entropy, one example a step, the rate falling to zero.

    `examples`: buckets and their shares of the text. A bucket has only its share of the gradient, so the embeddings'
    step is divided by the sum of squared shares: the text's average then moves by the rate, however many buckets it has.
    """
    rng, steps, done = np.random.default_rng(seed), epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at, share = examples[i]
            left = 1 - done / steps
            hidden = share @ model.embeddings[at]
            error = softmax(hidden @ model.weights + model.bias)
            error[labels[i]] -= 1
            back = model.weights @ error
            model.weights -= (rate * left) * np.outer(hidden, error)
            model.bias -= (rate * left) * error
            model.embeddings[at] -= (share * (rate * left / (share @ share)))[:, None] * back.astype(np.float32)
            done += 1


def calibrate(model: Model, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, error: float) -> None:
    """Temperature and threshold from examples that were not learned from.

    The temperature has the least cross-entropy (a golden-section search over its logarithm). The threshold is the
    smallest score from which on, one more error allowed for, at most a share `error` of predictions is wrong; nothing
    reaches it if these examples are too few or too hard to show that.
    """
    if not len(labels):
        return
    z = model.logits(texts)
    loss = lambda t: -np.log(np.maximum(softmax(z / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    low, high, golden = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    model.temperature = float(np.exp((low + high) / 2))
    p = softmax(z / model.temperature)
    order = np.argsort(-p.max(1), kind="stable")
    scores, wrong = p.max(1)[order], np.cumsum(p.argmax(1)[order] != labels[order])
    last = np.append(scores[1:] < scores[:-1], True)  # of equal scores all or none are accepted
    fine = np.flatnonzero(last & ((wrong + 1) / (np.arange(len(labels)) + 2) <= error))
    model.threshold = float(scores[fine[-1]]) if len(fine) else np.inf


def fit(examples: list[tuple[str, int, np.ndarray, np.ndarray]], epochs: int = 5, rate: float = 0.1, error: float = 0.01, seed: int = 5) -> Model:
    """A model from (language, hash of the text, buckets, shares); a fifth of the texts, by their hash, calibrates it."""
    languages = sorted({e[0] for e in examples})
    number = {name: k for k, name in enumerate(languages)}
    weights = np.random.default_rng(seed).standard_normal((WIDTH, len(languages))) / 2
    model = Model(languages, np.zeros((BUCKETS, WIDTH), np.float32), weights, np.zeros(len(languages)))
    examples = [e for e in examples if len(e[2])]
    few = len(examples) < 50
    learned, apart = ([e for e in examples if few or bool(e[1] % 5) is kind] for kind in (True, False))
    labels = lambda part: np.array([number[e[0]] for e in part], np.int64)
    if learned:
        descend(model, [e[2:] for e in learned], labels(learned), epochs, rate, seed)
    if not few:
        calibrate(model, [e[2:] for e in apart], labels(apart), error)
    return model


def train(docs: DataFrame, sample: int = 4096, **params) -> Model:
    """A model from `docs` (text, lang), by at most `sample` different texts, as many of each language.

    Rows with null text or lang, or no letter, do not count. Languages share the sample equally; of each language those
    texts are taken whose hashes are smallest, so copies count once and the choice does not depend on rows' order. If
    there are more languages than the sample has rows, the most frequent ones are learned. What comes to the driver is a
    row for each of these languages, then the sampled texts' counts, with one short piece of each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    known = known.filter(F.col("text").rlike(r"\p{L}")).withColumn("h", hash_bits(F.col("text")))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    quota = max(1, sample // max(1, len(sizes)))
    # some more than needed, as sizes are estimates
    limits = [(r["lang"], min(2**63 - 1, int((1.2 * quota + 16) / r["n"] * 2**63))) for r in sizes]
    picked = known.join(F.broadcast(spark.createDataFrame(limits, "lang string, most long")), "lang").filter("h <= most")
    texts = picked.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            rows = []
            for lang, h, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for short, part in ((False, text), (True, _piece(text, h))):
                    at, share = shares(subwords(part)[0])
                    rows.append((lang, h, short, at.tobytes(), share.tobytes()))
            yield pa.RecordBatch.from_pydict(dict(zip(("lang", "h", "short", "at", "share"), map(list, zip(*rows)))), schema=shape) if rows else pa.RecordBatch.from_pylist([], schema=shape)

    shape = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("short", pa.bool_()), ("at", pa.binary()), ("share", pa.binary())])
    got = sorted(texts.select("lang", "h", "text").mapInArrow(run, "lang string, h long, short boolean, at binary, share binary").collect(), key=lambda r: (r["lang"], r["h"], r["short"]))
    examples, taken = [], {}
    for r in got:
        seen = taken.setdefault(r["lang"], set())
        if r["h"] in seen or len(seen) < quota:
            seen.add(r["h"])
            examples.append((r["lang"], r["h"], np.frombuffer(r["at"], np.uint16), np.frombuffer(r["share"], np.float32)))
    return fit(examples, **params)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every row of `docs` (doc_id, text): each whole text by itself.

    score is the calibrated probability of the language, accepted whether it reaches the model's threshold. Texts that
    are null or have no letter, and all texts if no language was learned, are UNKNOWN with score 0, not accepted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = sent.value
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for lo in range(0, batch.num_rows, 64):
                part = [subwords(t.as_py() or "") for t in batch.column(1).slice(lo, 64)]
                if at := [k for k, (_, letters) in enumerate(part) if letters and model.languages]:
                    p = model.probabilities([shares(part[k][0]) for k in at])
                    for k, best, score in zip(at, p.argmax(1), p.max(1)):
                        names[lo + k], scores[lo + k] = model.languages[best], min(1.0, score)
            accepted = pa.array([name != UNKNOWN and s >= model.threshold for name, s in zip(names, scores)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), accepted], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def held_out(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of all `documents`, a row for each row, learned outside the held-out fold.

    A prediction follows from the text alone: equal texts have equal ones. A null doc_id counts as '' for the fold;
    repeated rows stay; further columns play no part; an empty table gives no rows. See `identify` for odd texts.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs.filter(~held_out("doc_id"))))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op12_language": op12_language}
ORACLE_SQL: dict[str, str] = {}
