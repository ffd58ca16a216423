import hashlib

from larkspur.llm import licenses
from tests.llm.conftest import ROWS
from tests.oracle import connect, rows_of, rows_of_sql


def scan(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scan(rows, licenses.known(spark)).collect()}


def test_same_license_in_other_spelling(spark):
    for name, body in licenses.TEXTS:
        lines = [line if "Copyright (c)" not in line else "  // Copyright (c) 1999-2020 Someone Else Inc." for line in body.split("\n")]
        other = "\n".join(lines).upper().replace("LICENSE", "LICENCE").replace(".", " .").replace(", ", " ,\n  ").replace('"', "'")
        found = scan(spark, [body, other, "All rights reserved.\n" + body, body + " And one more word.", body[:-20]])
        assert [found[i]["license"] for i in range(5)] == [name, name, name, None, None]


def test_notices_in_lines(spark):
    found = scan(spark, ["Some prose.\nReleased under the MIT licence!\nmore", "licensed under the apache license, version 2.0\nReleased under the MIT License.", "prose about the MIT License in general", "Released under the MIT License."])
    assert [(found[i]["license"], found[i]["notices"]) for i in range(4)] == [(None, "MIT"), (None, "Apache-2.0,MIT"), (None, ""), ("MIT", "MIT")]


def test_documents_against_sql(spark, sf_dir):
    got, expected = rows_of(licenses.op1_licenses(spark, sf_dir)), rows_of_sql(connect(sf_dir), licenses.ORACLE_SQL["op1_licenses"])
    assert got == expected


def test_odd_rows(spark, odd, none):
    got = licenses.scan(odd, licenses.known(spark)).collect()
    assert len(got) == len(ROWS) and {r["license"] for r in got} == {None}
    assert {r["digest"] for r in got if r["doc_id"] in (3, 4, 5)} == {hashlib.sha256(b"").hexdigest()}
    assert licenses.scan(none, licenses.known(spark)).count() == 0


def test_known_digests_differ(spark):
    rows = licenses.known(spark).collect()
    assert len(rows) == len({r["digest"] for r in rows}) >= 20


def test_noncommercial_notice(spark, documents):
    expected = {r["doc_id"] for r in documents.collect() if "Licensed under CC BY-NC 4.0." in (r["text"] or "").split("\n")}
    got = licenses.scan(documents, licenses.known(spark)).filter("array_contains(split(notices, ','), 'CC-BY-NC-4.0')").collect()
    assert expected and {r["doc_id"] for r in got} == expected


def test_full_texts(spark):
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0"} <= {name for name, _ in licenses.TEXTS}
    apache = next(body for name, body in licenses.TEXTS if name == "Apache-2.0" and "[yyyy]" in body)
    filled = apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Someone Else")
    assert filled != apache and scan(spark, [filled])[0]["license"] == "Apache-2.0"


def test_unicode_punctuation(spark):
    body = dict(licenses.TEXTS)["MIT"]
    curly = "\ufeff" + body.replace('"AS IS"', "\u201cAS IS\u201d").replace("NONINFRINGEMENT", "NON\u2011INFRINGEMENT").replace("free of charge", "free\u00a0of\u2003charge").replace(", and", " \u2014 and").replace("\n", "\r\n")
    found = scan(spark, [curly, body.replace("free", "fr\u00e9e")])
    assert [found[i]["license"] for i in range(2)] == ["MIT", None]


def test_copyright_lines_that_start_with_a_name(spark):
    body = dict(licenses.TEXTS)["MIT"]
    lines = ["Copyright Jane Doe 2020", "copyright by jane doe, 1999-2020", "Copyright The Project Authors.", "Copyright \u00c9mile Zola and Sons", "Copyright holders keep their rights", "Copyright License is granted"]
    found = scan(spark, [body.replace("Copyright (c) <year> <holder>", line) for line in lines])
    assert [found[i]["license"] for i in range(6)] == ["MIT"] * 4 + [None] * 2


def test_a_listed_point_is_no_copyright_line(spark):
    points = "(a) one thing;\n(b) another; and\n(c) the third one"
    digests = [r["digest"] for r in scan(spark, [points, points.replace("third", "fourth"), points.replace("the third", "the\nthird")]).values()]
    assert digests[0] != digests[1] and digests[0] == digests[2]


BSD = dict(licenses.TEXTS)["BSD-3-Clause"]
MIT = dict(licenses.TEXTS)["MIT"]


def test_titles_are_optional(spark):
    bare = {name: dict(licenses.TEXTS)[name].split("\n\n", 1)[1] for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "Zlib")}
    forms = [(name, text) for name, text in bare.items()]
    forms += [("MIT", f"{t}\n\n{bare['MIT']}") for t in ("The MIT License (MIT)", "The MIT License", "MIT", "# MIT License", "(The MIT License)")]
    forms += [("ISC", "ISC License (ISC)\n" + bare["ISC"]), ("BSD-3-Clause", "New BSD License\n\n" + bare["BSD-3-Clause"])]
    found = scan(spark, [text for _, text in forms])
    assert [found[i]["license"] for i in range(len(forms))] == [name for name, _ in forms]


def test_holders_bullets_and_breaks(spark):
    named = BSD.replace("the copyright holder nor", "Google Inc. nor")
    assert named != BSD
    provided = named.replace("BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "BY THE REGENTS AND CONTRIBUTORS").replace("SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE", "SHALL THE REGENTS OR CONTRIBUTORS BE")
    assert provided != named
    stars = "\n".join("* " + line[3:] if line[:2] in ("1.", "2.", "3.") else line for line in BSD.split("\n"))
    dashes = stars.replace("* ", "   - ")
    assert stars != BSD
    texts = [named, provided, stars, dashes, BSD.replace("\n\n", "<br>"), MIT.replace("\n\n", "<br />\n<br/>"), "<p>" + MIT.replace("\n\n", "</p>\n<p>") + "</p>"]
    found = scan(spark, texts)
    assert [found[i]["license"] for i in range(7)] == ["BSD-3-Clause"] * 5 + ["MIT"] * 2
    other = scan(spark, [BSD.replace("nor the names of its contributors", "nor others"), MIT.replace("AS IS", "AS IT WAS")])
    assert [other[i]["license"] for i in range(2)] == [None, None]


def test_addresses_and_free_software_lines(spark):
    gpl = next(body for name, body in licenses.TEXTS if name == "GPL-2.0")
    old = gpl.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")
    assert old != gpl
    found = scan(spark, [gpl, old, "\n".join("> " + line for line in gpl.split("\n"))])
    assert [found[i]["license"] for i in range(3)] == ["GPL-2.0"] * 3


def test_long_lines_and_far_points(spark):
    names = "Copyright " + "Foo " * 100_000
    far = "(a) one;\n(b) two;\n" + "word " * 30_000 + "\n(c) three"
    texts = [names, MIT.replace("Copyright (c) <year> <holder>", names), "copyright " * 100_000, "(c) " * 100_000, "in no event shall " * 50_000, "license " + "\n1. " * 100_000, far, far.replace("three", "four")]
    found = scan(spark, texts)
    assert found[0]["digest"] == hashlib.sha256(b"").hexdigest() and found[1]["license"] == "MIT"
    assert found[6]["digest"] != found[7]["digest"]


def test_sql_on_texts_made_of_licenses(spark, tmp_path):
    """Both sides on full texts and their forms, which the given tables lack."""
    texts = [body for _, body in licenses.titled(licenses.TEXTS)] + [BSD.replace("the copyright holder nor", "Google Inc. nor"), MIT.replace("\n\n", "<br>"), "Copyright The Project Authors, 2020\nAll rights reserved.\n" + MIT]
    texts += ["(a) x\n(b) y\n(c) z license", "(c) z license", "Copyright Jane Doe and Sons\nlicense", "Copyright License is granted", "a\nSPDX-License-Identifier: MIT\nb", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, expected = rows_of(licenses.op1_licenses(spark, str(tmp_path))), rows_of_sql(con, licenses.ORACLE_SQL["op1_licenses"])
    assert got == expected
    assert sum(r[2] is not None for r in got[1]) >= len(licenses.titled(licenses.TEXTS))
