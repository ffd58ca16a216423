import zlib
from collections import Counter, defaultdict

from larkspur.llm import sharding
from tests.llm.conftest import ROWS


def check(rows, texts, shards):
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bytes_are_near_equal(spark, sf_dir, documents):
    texts = [r["text"] for r in documents.collect()]
    rows = sharding.op10_sharding(spark, sf_dir).collect()
    check(rows, texts, 40)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    eight = sharding.shard(documents, shards=8).collect()
    check(eight, texts, 8)
    load = Counter()
    for r in eight:
        load[r["shard"]] += r["size"]
    largest = max(len((t or "").encode()) for t in texts) + 16
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 2 * largest
    assert sorted(map(str, eight)) == sorted(map(str, sharding.shard(documents.repartition(5), shards=8).collect()))


def test_leaves_follow_the_target(documents):
    total = sum(r["size"] for r in sharding.coordinates(documents).collect())
    rows = sharding.shard(documents, target_bytes=-(-total // 5)).collect()
    assert {r["shard"] for r in rows} == set(range(5))


def test_one_hot_text_is_split(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "'the same text everywhere' as text", "'en' as lang", "'s' as source")
    load = Counter(r["shard"] for r in sharding.shard(rows, shards=10).collect())
    assert len(load) == 10 and max(load.values()) - min(load.values()) <= 40


def test_whole_names_have_ranks(spark):
    """Names that are alike for long are told apart; the tree then cuts between them, not through them."""
    names = [f"https://example.org/a/very/long/path/{i}" for i in range(8)] + [None, ""]
    rows = spark.createDataFrame([(100 * i + j, f"{i:02} {j:02} some text", "en", n) for i, n in enumerate(names) for j in range(40)], "doc_id long, text string, lang string, source string")
    own = sharding.coordinates(rows)
    got = {r["x1"]: r["place"] for r in sharding.ranks(own, "x1").collect()}
    assert got == {n: i + 1.0 for i, n in enumerate(sorted(n for n in names if n is not None))}
    shards = {}
    for r in sharding.shard(rows, shards=5).collect():
        shards.setdefault(r["doc_id"] // 100, set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_any_partitioning_gives_the_same_rows(spark, documents):
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 9):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, sharding.shard(documents.repartition(n), shards=6).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_odd_rows(odd, none):
    check(sharding.shard(odd, shards=3).collect(), [r[1] for r in ROWS], 3)
    check(sharding.shard(odd, shards=40).collect(), [r[1] for r in ROWS], 40)
    assert sharding.shard(none, shards=4).count() == 0
