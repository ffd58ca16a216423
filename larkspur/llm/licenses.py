"""Operator 1: license scans by canonical digests (built-in functions only)."""

from __future__ import annotations

import functools
import operator
import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import let, read_table

#: Known licenses and notices as published (fixed values): identifier, text.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
)
_CC_TERMS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
for _terms in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    _name = "-".join(_CC_TERMS[t] for t in _terms.split("-"))
    NOTICES += tuple(
        (f"CC-{_terms}-4.0", notice)
        for notice in (f"Licensed under CC {_terms} 4.0.", f"This work is licensed under CC {_terms} 4.0.", f"This work is licensed under a Creative Commons {_name} 4.0 International License.", f"SPDX-License-Identifier: CC-{_terms}-4.0")
    )


def _published(license: str) -> tuple[tuple[str, str], ...]:
    """A long license as published: entire, and without what follows its end of terms (how to apply it)."""
    text = pkgutil.get_data("larkspur.llm", f"license_texts/{license}.txt").decode().strip()
    head, end, _ = text.partition("END OF TERMS AND CONDITIONS")
    return ((license, text), (license, head + end)) if end else ((license, text),)


TEXTS = (
    ("MIT", """MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """BSD Zero Clause License

Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """BSD 2-Clause License

Copyright (c) <year>, <holder>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """BSD 3-Clause License

Copyright (c) <year>, <holder>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """zlib License

Copyright (c) <year> <holder>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
)
for _license in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0"):
    TEXTS += _published(_license)
#: How short licenses are headed (fixed values); their texts are known without a title and under each of these.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "License: MIT", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "FreeBSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License", "The BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Spellings that mean the same, in canonical texts (fixed values): what is written, what it becomes.
SPELLINGS = (
    ("licence", "license"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("http", "https"),
    ("httpss", "https"),
    ("59 temple place suite 330 boston ma 02111 1307 usa", "51 franklin street fifth floor boston ma 02110 1301 usa"),
    ("675 mass ave cambridge ma 02139 usa", "51 franklin street fifth floor boston ma 02110 1301 usa"),
)
#: In canonical texts, where a holder is named (by 40 words at most); what is between the two phrases becomes the last.
HOLDERS = (
    ("neither the name of", "nor the names of its contributors", "the copyright holder"),
    ("neither the names of", "nor the names of its contributors", "the copyright holder"),
    ("this software is provided by", "as is and any", "the copyright holders and contributors"),
    ("in no event shall", "be liable for any", "the copyright holders"),
)
#: Texts with none of these (in lower case) are no license, and need no more than lower case and single spaces.
_SIGNS = ("licen", "copyright", "permission")
_OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Unicode: dashes become hyphens, other marks and spaces from U+0080 up blanks.
_DASHES, _MARKS = r"[\x{2010}-\x{2015}\x{2212}\x{FE58}\x{FE63}\x{FF0D}]", r"[\r\x{80}-\x{10FFFF}&&[^\p{L}\p{M}\p{N}©]]"
_BREAKS = r"(?i)<[ \t]*/?[ \t]*(br|p)[ \t]*/?>"
_LEAD = r"^[ \t#*/;>-]*"
#: Of a line: it says whose the rights are in so many words; it does if it has a year; it does if only names follow.
_CLEAR = rf"(?i){_LEAD}(\(c\)|©|copyright[ \t:]+(\(c\)|©|[0-9<\[{{]))"
_DATED = rf"(?i){_LEAD}copyright[ \t].*\b(19|20)[0-9]{{2}}\b"
_NAMED = rf"{_LEAD}Copyright[ \t]+(by[ \t]+)?(?!(Holder|Owner|Licen[sc]e|Notice|Law|Act|Statement|Interest|Protection)s?\b)\p{{Lu}}"
_NAME = r"^((\p{Lu}|[0-9])[\p{L}\p{M}0-9.'&-]*|and|of|the|by|&|)$"
_RESERVED = rf"(?i){_LEAD}all rights reserved\.?[ \t]*$"
#: A license that must be copied as it is holds its author's copyright line as words of its own, where it has this permission.
_VERBATIM, _FOUNDATION = r"everyone\s+is\s+permitted\s+to\s+copy", r"(?i)copyright[ \t]+(\(c\)|©)([0-9,\s-]+free software foundation|[ \t]+year\b)"
#: The mark of a listed point at the start of a line, in brackets anywhere, and those of the second and third point.
_POINT = r"(^|\n)[ \t#*/;>-]*([0-9]{1,2}[ \t]*[.)]|[a-z][ \t]*\)|[•‣◦])[ \t]+"
_INSIDE = r"\(([ivx]{1,4}|[a-z]|[0-9]{1,2})\)"
_SECOND, _THIRD = rf"(?i){_LEAD}\(b\)", rf"(?i){_LEAD}\(c\)"


def _without_holders(text: Column) -> Column:
    """The lines that do not say who holds the copyright. "(c)" begins such a line, but not after a point "(b)"."""

    def owned(line, number, second):
        named = line.rlike(_NAMED) & F.forall(F.split(line, "[ \t,]+"), lambda w: w.rlike(_NAME) | w.rlike(r"^[#*/;>-]*$"))
        listed = line.rlike(_THIRD) & (second > 0) & (number >= second)
        return (line.rlike(_CLEAR) & ~listed) | line.rlike(_DATED) | named | line.rlike(_RESERVED)

    def kept(lines):
        second = F.array_position(F.transform(lines, lambda line: line.rlike(_SECOND)), True)
        return let(second, lambda second: F.filter(lines, lambda line, i: ~owned(line, i, second)))

    return F.array_join(let(F.split(text, "\n"), kept), "\n")


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit("©"), F.lit(" ")), _OTHER, " "))


def canonical(text: Column) -> Column:
    """Lower case, and all but letters and digits to single spaces; of texts with a license's words also without copyright
    lines and marks of listed points, with one spelling for equivalent ones and one holder for all.

    Every pattern is for one line or a few words and repeats no group, so neither long lines nor long texts matter.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    folded = F.when(text.rlike(_MARKS), F.regexp_replace(F.regexp_replace(text, _DASHES, "-"), _MARKS, " ")).otherwise(text)
    has = lambda small, *signs: functools.reduce(operator.or_, (small.contains(sign) for sign in signs))

    def license_words(text, small):
        own = F.when(small.rlike(_VERBATIM), F.regexp_replace(text, _FOUNDATION, "of copyright c $2")).otherwise(text)
        lines = F.regexp_replace(own, _BREAKS, "\n")
        lines = let(lines, lambda x: F.when(has(small, "copyright", "(c)", "©", "all rights"), _without_holders(x)).otherwise(x))
        out = _spaced(F.regexp_replace(F.regexp_replace(F.lower(lines), _INSIDE, " "), _POINT, "$1"))
        for written, becomes in SPELLINGS:
            out = F.replace(out, F.lit(written), F.lit(becomes))
        for before, after, holder in HOLDERS:
            out = F.regexp_replace(out, rf"{before} ([^ ]+ ){{1,40}}?{after}", f"{before} {holder} {after}")
        return out

    return let(folded, lambda text: let(F.lower(text), lambda small: F.when(has(small, *_SIGNS), license_words(text, small)).otherwise(_spaced(small))))


def _hash(value: Column) -> Column:
    """Never null, so that no join on it adds a filter that computes it once more."""
    return F.coalesce(F.sha2(value, 256), F.lit(""))


def digest(text: Column) -> Column:
    return _hash(canonical(text).cast("binary"))


def titled(licenses: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    """The list, and each text of it that stands under one of its license's titles without it and under the others."""
    out = list(licenses)
    for name, body in licenses:
        title, _, rest = body.partition("\n\n")
        bare = rest if title in TITLES.get(name, ()) else body if name in TITLES and len(body) > 400 else None
        if bare:
            out += [(name, bare), *((name, f"{other}\n\n{bare}") for other in TITLES[name])]
    return out


def known(spark: SparkSession, licenses: tuple[tuple[str, str], ...] = TEXTS + NOTICES) -> DataFrame:
    """digest, license: one row for each different canonical text of the list (a table a few times as long as the list)."""
    rows = spark.createDataFrame(titled(licenses), "license string, body string")
    return rows.select(digest(F.col("body")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """doc_id, digest, license, notices for every row of `docs` (doc_id, text).

    license: what the entire text is, by its canonical digest, or null; notices: the distinct licenses, sorted and
    comma-joined, of lines that are entire texts of the list by themselves ('' for none). Known digests come from a list
    as long as `licenses`, which is broadcast, so texts are not shuffled; findings in lines are kept by the text's own
    hash and joined back to all rows that hold it. Null texts are empty, and no license; repeated rows stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"))
    # lines and the text's hash are made below the generator: above it, the whole text would come along with every line
    cut = texts.select(_hash(F.col("text")).alias("blob"), F.split("text", "\n").alias("lines"))
    lines = cut.select("blob", F.explode_outer("lines").alias("line")).filter(F.trim("line") != "")
    hits = lines.select("blob", digest(F.col("line")).alias("digest")).join(F.broadcast(licenses), "digest")
    found = hits.groupBy("blob").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    whole = texts.select("doc_id", _hash(F.col("text")).alias("blob"), digest(F.col("text")).alias("digest")).join(F.broadcast(licenses), "digest", "left")
    return whole.join(found, "blob", "left").select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses and notices of all `documents`, a row for each row; see `scan`.

    Null texts are empty and no license; repeated rows stay; further columns play no part; an empty table gives no rows.
    """
    return scan(read_table(spark, sf_dir, "documents"), known(spark))


def _sql() -> str:
    """Written for RE2: whole copyright lines go by one expression, names of any number by a repeated group."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rights = (
        r"^[ \t#*/;>-]*(?i:\(c\)|©|copyright[ \t:]+(?:\(c\)|©|[0-9<\[{]))",
        r"^[ \t#*/;>-]*(?i:copyright)[ \t].*\b(?:19|20)[0-9]{2}\b",
        r"^[ \t#*/;>-]*Copyright[ \t]+(?:by[ \t]+)?\p{Lu}[\p{L}\p{M}0-9.'&-]*(?:[ \t,]+(?:(?:\p{Lu}|[0-9])[\p{L}\p{M}0-9.'&-]*|and|of|the|by|&))*[ \t,]*$",
        r"^[ \t#*/;>-]*(?i:all rights reserved)\.?[ \t]*$",
    )
    no_names = r"^[ \t#*/;>-]*Copyright[ \t]+(?:by[ \t]+)?(?:Holder|Owner|License|Licence|Notice|Law|Act|Statement|Interest|Protection)s?\b"

    def digest_of(column: str) -> str:
        text = f"coalesce({column}, '')"
        has = lambda *signs: "(" + " OR ".join(f"contains(lower({text}), {quote(s)})" for s in signs) + ")"
        own = f"CASE WHEN regexp_matches(lower({text}), {quote(_VERBATIM)}) THEN regexp_replace({text}, {quote(r'copyright[ \t]+(?:[(]c[)]|©)([0-9,\s-]+free software foundation|[ \t]+year\b)')}, 'of copyright c \\1', 'gi') ELSE {text} END"
        lines = f"string_split(regexp_replace({own}, {quote(r'<[ \t]*/?[ \t]*(?:br|p)[ \t]*/?>')}, chr(10), 'gi'), chr(10))"
        second = f"list_position(list_transform({lines}, lambda b: regexp_matches(b, {quote('^[ \t#*/;>-]*(?i:[(]b[)])')})), true)"
        listed = f"(regexp_matches(x, {quote('^[ \t#*/;>-]*(?i:[(]c[)])')}) AND coalesce({second}, 0) BETWEEN 1 AND i - 1)"
        owned = f"(regexp_matches(x, {quote(rights[0])}) AND NOT {listed}) OR regexp_matches(x, {quote(rights[1])}) OR (regexp_matches(x, {quote(rights[2])}) AND NOT regexp_matches(x, {quote(no_names)})) OR regexp_matches(x, {quote(rights[3])})"
        kept = f"CASE WHEN {has('copyright', '(c)', '©', 'all rights')} THEN array_to_string(list_filter({lines}, lambda x, i: NOT ({owned})), chr(10)) ELSE array_to_string({lines}, chr(10)) END"
        spaced = lambda s: f"trim(regexp_replace(replace({s}, '©', ' '), {quote(_OTHER)}, ' ', 'g'))"
        out = spaced(f"regexp_replace(regexp_replace(lower({kept}), {quote('[(](?:[ivx]{1,4}|[a-z]|[0-9]{1,2})[)]')}, ' ', 'g'), {quote(r'(^|\n)[ \t#*/;>-]*(?:[0-9]{1,2}[ \t]*[.)]|[a-z][ \t]*\)|[•‣◦])[ \t]+')}, '\\1', 'g')")
        for written, becomes in SPELLINGS:
            out = f"replace({out}, {quote(written)}, {quote(becomes)})"
        for before, after, holder in HOLDERS:
            out = f"regexp_replace({out}, {quote(f'{before} (?:[^ ]+ ){{1,40}}?{after}')}, {quote(f'{before} {holder} {after}')}, 'g')"
        return f"sha256(CASE WHEN {has(*_SIGNS)} THEN {out} ELSE {spaced(f'lower({text})')} END)"

    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in titled(TEXTS + NOTICES))
    folded = lambda column: f"regexp_replace(regexp_replace(coalesce({column}, ''), {quote(_DASHES)}, '-', 'g'), {quote('[^\\x{0}-\\x{7F}\\p{L}\\p{M}\\p{N}©]|\\r')}, ' ', 'g')"
    return f"""
WITH d AS (SELECT doc_id, {folded("text")} AS text FROM documents),
given AS (SELECT license, {folded("body")} AS body FROM (VALUES {values}) AS t(license, body)),
known AS (SELECT {digest_of("body")} AS digest, min(license) AS license FROM given GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
hits AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, {digest_of("line")} AS digest FROM lines WHERE trim(line) <> '') JOIN known USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, {digest_of("text")} AS digest FROM d)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices FROM whole LEFT JOIN known USING (digest) LEFT JOIN hits USING (doc_id)"""


QUERIES = {"op1_licenses": op1_licenses}
ORACLE_SQL = {"op1_licenses": _sql()}
