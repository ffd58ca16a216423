import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import mixing
from larkspur.llm.common import hash_bits
from tests.llm.conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [1, 2, 3], 30) == pytest.approx([5, 10, 15])
    # the first two are cut at three times their size, the third takes the rest
    assert mixing.water_fill([1, 2, 97], [1, 2, 3], 100) == pytest.approx([3, 6, 91])
    assert mixing.water_fill([0, 10], [1, 2], 10) == pytest.approx([0, 10])
    assert mixing.water_fill([], [], 0) == []


def test_split_tree_is_exact():
    quotas = np.array([100, 7, 0, 33])
    dealt = mixing.split_tree(quotas, 6, 1)
    assert (dealt.sum(axis=1) == quotas).all() and (dealt >= 0).all()
    assert dealt.sum(axis=0).max() - dealt.sum(axis=0).min() <= 3
    assert (dealt == mixing.split_tree(quotas, 6, 1)).all()


def check(rows, texts):
    taken, target = defaultdict(int), {}
    for r in rows:
        words = sum(d["words"] for d in r["draws"])
        assert words <= 3 * r["size"] and all(d["words"] > 0 for d in r["draws"])
        for n in {d["round"] for d in r["draws"]}:  # in a round no word is drawn twice
            own = sorted((d["from"], d["words"]) for d in r["draws"] if d["round"] == n)
            assert all(a + n <= b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= r["size"]
        taken[r["source"]] += words
        target[r["source"]] = r["target"]
    for source, words in taken.items():
        assert abs(words - target[source]) <= 0.5
    assert sum(target.values()) == pytest.approx(sum(len(WORD.findall(t or "")) for t in texts))


def plain(rows, shards, block_words, seed, tree=mixing.split_tree):
    """The mixture word by word: `rows` are (source, size, place in the source's order); draws as (round, shard, words)."""
    by = defaultdict(list)
    for i, (source, size, rank) in enumerate(rows):
        by[source].append((rank, size, i))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n, _ in by[s]) for s in names]
    targets = mixing.water_fill(sizes, [i % 3 + 1 for i in range(len(names))], sum(sizes))
    plans = [mixing.Source.of(str(s), n, t, block_words) for s, n, t in zip(names, sizes, targets)]
    dealt = tree(np.array([q for p in plans for q in (p.full * p.blocks, p.quota)]), shards, seed)
    out = [Counter() for _ in rows]
    for k, (source, p) in enumerate(zip(names, plans)):
        owner = [i for _, n, i in sorted(by[source]) for _ in range(n)]
        spots = [w // p.block for w in range(p.size)]
        first = {}
        for w, i in enumerate(owner):
            first.setdefault(i, spots[w])
        # whole rounds
        a, c = mixing._stride(max(1, p.full * p.blocks), seed + 1)
        line = [s for s in range(shards) for _ in range(dealt[2 * k][s])]
        for r in range(p.full):
            for i in owner:
                out[i][r, line[(a * (r * p.blocks + first[i]) + c) % len(line)]] += 1
        # the other one
        a, c = mixing._stride(p.blocks, seed)
        block_at = {(a * b + c) % p.blocks: b for b in range(p.blocks)}
        assert len(block_at) == p.blocks
        shard_of, done = {}, 0
        for s in range(shards):
            q = int(dealt[2 * k + 1][s])
            for at in range(done * p.blocks // max(1, p.quota), done * p.blocks // max(1, p.quota) + q):
                assert block_at[at] not in shard_of
                shard_of[block_at[at]] = s
            done += q
        kept = [w for w in range(p.size) if spots[w] in shard_of]
        if p.quota:
            last = list(shard_of)[-1]
            words = [w for w in kept if spots[w] == last]
            gone = set(words[len(words) - (len(kept) - (p.take - p.full * p.size)) :])
            kept = [w for w in kept if w not in gone]
        before = None
        for w in kept:
            s = before[2] if before and before[:2] == (w - 1, owner[w]) else shard_of[spots[w]]
            out[owner[w]][p.full, s] += 1
            before = (w, owner[w], s)
    return out


def drawn(row):
    out = Counter()
    for d in row["draws"]:
        out[d["round"], d["shard"]] += d["words"]
    return out


def all_to_one(quotas, shards, seed):
    out = np.zeros((len(quotas), shards), dtype=np.int64)
    out[:, 0] = quotas
    return out


@pytest.mark.parametrize("block_words", [7, 100, 4096])
def test_mix_is_that_of_brute_force(spark, documents, block_words):
    docs = documents.filter("doc_id < 90")
    rows = mixing.mix(docs, shards=5, block_words=block_words).collect()
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[r["source"]].append((r["doc_id"], r["tie"], i))
    hashed = {r["doc_id"]: r["h"] for r in mixing.mix(docs).select("doc_id", hash_bits(F.col("doc_id"), F.col("tie"), F.col("size")).alias("h")).collect()}
    for tree in (mixing.split_tree, all_to_one):
        got = rows if tree is mixing.split_tree else mixing.mix(docs, shards=5, block_words=block_words, tree=tree).collect()
        expected = plain([(r["source"], r["size"], hashed[r["doc_id"]]) for r in got], 5, block_words, 17, tree)
        assert [drawn(r) for r in got] == expected


def test_targets_are_met(spark, documents):
    rows = mixing.mix(documents, shards=5, block_words=100).collect()
    check(rows, [r["text"] for r in documents.collect()])
    assert len(rows) == documents.count()
    assert {d["shard"] for r in rows for d in r["draws"]} == set(range(5))


def test_the_tree_decides_what_is_drawn(spark, documents):
    own = {r["doc_id"]: (sum(d["words"] for d in r["draws"]), drawn(r)) for r in mixing.mix(documents, shards=5, block_words=100).collect()}
    other = {r["doc_id"]: (sum(d["words"] for d in r["draws"]), drawn(r)) for r in mixing.mix(documents, shards=5, block_words=100, tree=all_to_one).collect()}
    assert sum(own[i][0] != other[i][0] for i in own) > 5 and sum(own[i][1] != other[i][1] for i in own) > 50


def test_any_partitioning_gives_the_same_rows(spark, sf_dir, documents):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in (1, 4, 9, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append((sorted(map(str, mixing.mix(documents.repartition(n), shards=5, block_words=100).collect())), sorted(map(str, mixing.op3_mixing(spark, sf_dir).collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(s == seen[0] for s in seen)


def test_alike_rows_of_other_sources_keep_their_rates(spark):
    """40 pairs alike in id and text, one of source a, one of b, and 40 further rows of b."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(50))
    rows = [(i, text(i), s, None) for i in range(40) for s in "ab"] + [(100 + i, text(100 + i), "b", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    target = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    words = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - target[s]) <= 0.5 for s in "ab")


def test_mixture_is_shuffled_by_shard(spark, documents):
    out = mixing.mixed_documents(documents, shards=3, block_words=100)
    order = [r["doc_id"] for r in out.collect()]
    assert order == [r["doc_id"] for r in mixing.mixed_documents(documents, shards=3, block_words=100).collect()] and order != sorted(order)
    assert Counter(order) == Counter(r["doc_id"] for r in mixing.mix(documents, shards=3, block_words=100).collect() for _ in r["draws"])


def test_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    check(rows, [r[1] for r in ROWS])
    assert sorted(r["size"] for r in rows) == sorted(len(WORD.findall(r[1] or "")) for r in ROWS)
    assert mixing.mix(none).collect() == []
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and mixing.mixed_documents(none).count() == 0
    words = sum(len(WORD.findall(r["text"])) for r in out.collect())
    assert words == sum(d["words"] for r in rows for d in r["draws"])
