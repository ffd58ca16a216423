import hashlib
import re

from pyspark.sql import functions as F

from larkspur.llm import secrets
from tests.llm.conftest import ROWS

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


MORE = [
    r"gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{10,}",
    r"eyJ[\w-]{10,1000}\.[\w-]{10,}\.[\w-]+",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----",
    r"(?:https?|s?ftp|ssh|smtps?|ldaps?|mysql|postgres|postgresql|mongodb|rediss?|amqps?)://[^/\s:@?#]+:[^/\s@?#]+@",
]
KINDS = ["host_token", "chat_token", "signed_token", "private_key", "url_password"]


def plain(text, more=True):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    if more:
        spans += [(m.start(), 3 + i, k, m.end()) for i, (k, p) in enumerate(zip(KINDS, MORE)) for m in re.finditer(p, text, re.A)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))


def test_documents(spark, sf_dir, documents):
    expected = {r["doc_id"]: plain(r["text"]) for r in documents.collect()}
    base = {r["doc_id"]: plain(r["text"], False) for r in documents.collect()}
    for r in secrets.op5_secrets(spark, sf_dir).collect():
        assert r["spans"] == expected[r["doc_id"]] and r["base_sha256"] == hashlib.sha256(base[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(odd, none):
    found = secrets.findings(odd, secrets.scan(odd)).select("doc_id", secrets.joined(F.col("spans")).alias("s"))
    assert sorted((str(r["doc_id"]), r["s"]) for r in found.collect()) == sorted((str(r[0]), plain(r[1])) for r in ROWS)
    assert secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns and clean.count() == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[7] == "naïve ünï çöde 𝔘𝔫𝔦 [secret] x" and texts[None] == "no id but [secret] and more words" and texts[3] is None
    assert texts[9] == "secret: token: abcdefgh and token=a and api-key=nothing [secret]'"


def test_overlapping_spans_are_one(spark):
    text = "secret=0123456789abcdef0123456789abcdef end"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.redact(rows).first()["text"] == "[secret] end"


def test_ledger_grows_only_by_the_unseen(spark, odd):
    first = secrets.scan(odd)
    more = spark.createDataFrame([(20, "password=another1"), (21, ROWS[0][1])], "doc_id long, text string")
    new = secrets.scan(more, first)
    assert [r["blob"] for r in new.collect()] == [hashlib.sha256(b"password=another1").hexdigest()]
    assert secrets.scan(odd, first).count() == 0
    assert secrets.scan(odd, first, version="2").count() == first.count() == len({r[1] or "" for r in ROWS})
    both = first.unionByName(new)
    assert {r["doc_id"]: len(r["spans"]) for r in secrets.findings(more, both).collect()} == {20: 1, 21: 0}


def test_ledger_table(spark, odd, none, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.rows().count() == 0 and ledger.update(none).rows().count() == 0
    texts = {r[1] or "" for r in ROWS}
    ledger.update(odd.filter("doc_id < 5")).update(odd).update(odd)
    blobs = [r["blob"] for r in ledger.rows().collect()]
    assert len(blobs) == len(set(blobs)) == len(texts)
    # the same batch appended twice by hand, and another version's findings, change nothing
    ledger.rows().write.mode("append").partitionBy("rule_version").parquet(str(tmp_path / "copy"))
    ledger.rows().write.mode("append").partitionBy("rule_version").parquet(str(tmp_path / "copy"))
    other = secrets.Ledger(spark, str(tmp_path / "copy"), "another").update(odd)
    assert other.rows().count() == 3 * len(texts)
    for found in (ledger.findings(odd), secrets.Ledger(spark, str(tmp_path / "copy")).findings(odd), other.findings(odd)):
        got = found.select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()
        assert sorted((str(r["doc_id"]), r["s"]) for r in got) == sorted((str(r[0]), plain(r[1])) for r in ROWS)


def test_the_version_follows_the_rules():
    assert secrets.RULE_VERSION == hashlib.sha256(repr(secrets.RULES).encode()).hexdigest()[:16]


def test_many_secrets_in_one_text_take_seconds(spark):
    import time

    text = "".join(f"é{i} token=abcdef{i:06d} " for i in range(100_000))
    rows = spark.createDataFrame([(1, text), (2, "secret=abcdefgh")], "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r["s"] for r in secrets.findings(rows, secrets.scan(rows)).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert found[1] == plain(text) and found[2] == "assign:0:15"
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(rows).collect()}
    assert clean == {1: "".join(f"é{i} [secret] " for i in range(100_000)), 2: "[secret]"}
    assert time.time() - began < 60


def test_prefixes(spark):
    rows = spark.createDataFrame([([],), ([3],), (list(range(1, 400)),), ([5, 1, 9, 2] * 40,)], "v array<int>")
    got = rows.select("v", secrets._before(F.col("v"), lambda a, b: a + b).alias("sums"), secrets._before(F.col("v"), F.greatest).alias("tops")).collect()
    for r in got:
        assert r["sums"] == [sum(r["v"][:i]) for i in range(len(r["v"]))]
        assert r["tops"] == [max([0, *r["v"][:i]]) for i in range(len(r["v"]))]


def test_kinds_beyond_the_base(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIEow\nabc+/=\n-----END RSA PRIVATE KEY-----"
    texts = [f"x ghp_{'a1B2' * 10} y", "is xoxb-1234567890-abcDEF.", f"jwt eyJ{'a' * 12}.{'b' * 12}.c-_d end", f"k {key} l", "see https://user:pa55word@host/path or ftp://host:21/", "-----BEGIN PRIVATE KEY----- no end", "gh_short xoxb-1 eyJa.b.c http://b:c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["s"] for r in secrets.findings(rows, secrets.scan(rows)).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts)}
    assert found[0] == "host_token:2:46" and found[3] == f"private_key:2:{2 + len(key)}" and found[4] == "url_password:4:26" and found[5] == found[6] == ""
    assert secrets.redact(rows).filter("doc_id = 4").first()["text"] == "see [secret]host/path or ftp://host:21/"


def test_texts_made_to_go_wrong(spark):
    texts = ["eyJ" * 200_000, "-----BEGIN " + "A " * 200_000, "-----BEGIN PRIVATE KEY-----" * 20_000, "a" * 1_000_000 + "://", "http://" * 100_000, "secret" * 100_000, "0" * 1_000_000, "token=" * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["s"] for r in secrets.findings(rows, secrets.scan(rows)).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts)}
