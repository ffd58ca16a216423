import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from larkspur.llm import packing
from tests.llm.conftest import ROWS


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def check(rows, texts, tokenizer, capacity):
    """texts: list of (doc_id, text), ids not repeated."""
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for n, r in enumerate(sorted(docs[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            assert r["length"] == capacity or n == 0
            at += r["length"]
        assert at == len(ids) and len(docs[i]) == -(-len(ids) // capacity)
    return len(bins)


def test_documents(spark, sf_dir, documents, tokenizer):
    rows = packing.op9_packing(spark, sf_dir).collect()
    used = check(rows, [(r["doc_id"], r["text"]) for r in documents.collect()], tokenizer, 2048)
    assert used <= 1.03 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_ids_come_along(documents):
    small = documents.limit(20)
    for r in packing.packed(small, packing.tokenizer_path(), 128, ids=True).collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_encoder_is_the_tokenizer(tokenizer, documents):
    encode = packing.Encoder(packing.tokenizer_path())
    texts = [r["text"] for r in documents.limit(60).collect()] + [r[1] or "" for r in ROWS] + ["it's <|endoftext|> here", "  two  spaces \n\n tabs\t\t1234 ½ 漢字 😀", " "]
    assert encode.ranks is not None
    for t in texts:
        assert encode(t) == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once(seed):
    rng, capacity = random.Random(seed), 200
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([1, 7, 300, 2000]))] + [17] * rng.choice([0, 500])
    histogram = Counter(lengths)
    plan = packing.Plan(histogram, capacity, groups=16)
    load, placed = Counter(), Counter()
    for length, first, count, times, sequence, offset in plan.entries:
        for rank in range(count * times):
            placed[length, first + rank] += 1
            load[sequence + rank % count] += length
            assert offset + (rank // count + 1) * length <= capacity
    assert placed == {(k, i): 1 for k, n in histogram.items() for i in range(n)}
    assert max(load.values()) <= capacity and len(load) == plan.sequences
    least = -(-sum(lengths) // capacity)
    assert plan.sequences <= 1.1 * max(least, sum(x > capacity // 2 for x in lengths)) + 17


def test_linear_groups():
    groups = packing.linear_groups({10: 3, 7: 2, 5: 5}, 4)
    assert [size for size, _ in groups] == [10, 7, 5, 5]
    assert [sum(n for _, n in items) for _, items in groups] == [3, 3, 3, 1]


def test_odd_rows(odd, none, tokenizer):
    rows = packing.packed(odd, packing.tokenizer_path(), 64).collect()
    assert sum(r["doc_id"] == 7 for r in rows) == 2 * -(-(len(tokenizer.encode(ROWS[7][1]).ids) + 1) // 64)
    load = defaultdict(int)
    for r in rows:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 64
    assert packing.packed(none, packing.tokenizer_path()).count() == 0


def test_too_few_rounds_are_said(recwarn):
    sizes, need = [700, 600, 500, 400, 300], [7, 11, 13, 17, 19]
    held = lambda plan: [sum(fill.get(i, 0) * uses for fill, uses in plan) for i in range(len(sizes))]
    whole = packing.configurations(sizes, need, 2048)
    assert not recwarn.list and held(whole) == need
    with pytest.warns(UserWarning, match="did not reach"):
        cut = packing.configurations(sizes, need, 2048, rounds=0)
    assert held(cut) == need and sum(u for _, u in cut) >= sum(u for _, u in whole)


def test_long_white_space_goes_through_the_tokenizer_itself():
    encode = packing.encoder(packing.tokenizer_path())
    for text in ("a" + " " * 2_000_000 + "b", "\n" * 150_000 + "x", "\u3000" * 120_000, " \t" * 49_999 + " x"):
        assert encode(text) == encode.tokenizer.encode(text, add_special_tokens=False).ids
