"""Licence scans by canonical digest.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent spellings), and the
digest of the whole of it joins the digests of known licence texts and notices. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: spellings that licence matching guidelines treat as the same word, and notice lines that carry no terms
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)
_COPYRIGHT_LINE = r"(?im)^[ \t>*#/;-]*(copyright\b|\(c\)|©|all rights reserved)[^\n]*"
_PUNCTUATION = r"[^\p{L}\p{N}]+"

# fixed values: texts of short licences and the usual notices of longer ones
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "MIT notice": "Licensed under the MIT License.",
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 notice": "Licensed under CC0 1.0.",
}

# fixed values: notices that are looked for in lines and paragraphs besides KNOWN
NOTICES = {
    "MIT notice": "Released under the MIT License.",
}
# whole licences besides KNOWN
BODIES = {
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
BODIES["BSD-3-Clause"] = BODIES["BSD-2-Clause"].replace("THIS SOFTWARE IS", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS")
# digests by body() of the published texts of longer licences; where there is an appendix, also without it
DIGESTS = {
    "Apache-2.0": (
        "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
        "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f",
        "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40",
    ),
    "GPL-2.0": (
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
    ),
    "GPL-3.0": (
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
    ),
    "LGPL-2.1": (
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    ),
    "MPL-2.0": (
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    ),
    "CC0-1.0": (
        "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    ),
    "Artistic-1.0": (
        "7684e7ab2b843b2ea93db77f1db7f373c6a2c3be0cb5c87cb97f1c1752ab1cf4",
    ),
}
# a copyright mark with a year, a sign, a holder or a place for them; and lines that are only a licence's title
_HOLDER_LINE = r"(?im)^[ \t>*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|[\[<{:]|by\b)|(?-i:Copyright[ \t]+\p{Lu})|©|\(c\)[ \t]*(copyright[ \t]*)?[0-9]{4}|all rights reserved)[^\n]*"
_TITLE_LINE = r"(?im)^[ \t>*#/;=-]*(the )?(mit|x11|isc|0bsd|(bsd )?zero[ -]clause( bsd)?|bsd [23][ -]clause( \"[a-z]+\"( or \"[a-z]+\")?)?|(new|modified|revised|simplified) bsd|bsd)[ -]licen[sc]e( \([^()\n]*\))?[ \t:.=*-]*\r?$"
_PARAGRAPH = r"\r?\n[ \t\r]*\n"


def canonical(text: Column, dropped: str | None = _COPYRIGHT_LINE) -> Column:
    """Lower case, without copyright lines, words apart by one blank, spellings made equal."""
    out = text if dropped is None else F.regexp_replace(text, dropped, " ")
    out = F.trim(F.regexp_replace(F.lower(out), _PUNCTUATION, " "))
    out = F.concat(F.lit(" "), F.replace(out, F.lit(" "), F.lit("  ")), F.lit(" "))  # each word has blanks of its own
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def body(text: Column) -> Column:
    """As canonical, with only such copyright lines dropped as name a year or holder, and without title lines."""
    return canonical(F.regexp_replace(F.regexp_replace(text, _HOLDER_LINE, " "), _TITLE_LINE, " "), None)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license, digest) of the known texts; one name a digest, the least."""
    rows = spark.createDataFrame(sorted((KNOWN if texts is None else texts).items()), "license string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """The input's rows and columns with `digest`, of the canonical text, and `license`, null where the digest is unknown.

    A null text has no digest; texts without any letter or digit share the digest of the empty text, which is no licence
    unless `known` has it. The join is by hash of the digest; Spark broadcasts `known` where it is small. Columns named
    like the new ones are replaced.
    """
    known = (known_licenses(docs.sparkSession) if known is None else known).select(F.col("digest").alias("_known_digest"), F.col("license").alias("_known_license"))
    keep = [c for c in docs.columns if c not in ("digest", "license")]
    out = docs.select(*keep).withColumn("digest", digest(F.col(text_col).cast("string")))
    return out.join(known, F.col("digest") == F.col("_known_digest"), "left").select(*keep, "digest", F.col("_known_license").alias("license"))


def _looked_for(spark: SparkSession) -> DataFrame:
    """(license, digest) of KNOWN and NOTICES."""
    rows = spark.createDataFrame(sorted([*KNOWN.items(), *NOTICES.items()]), "license string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def _bodies(spark: SparkSession) -> DataFrame:
    """(license, digest) of KNOWN, NOTICES and BODIES by their body, and DIGESTS."""
    rows = spark.createDataFrame(sorted([*KNOWN.items(), *NOTICES.items(), *BODIES.items()]), "license string, text string")
    rows = rows.select("license", F.sha2(body(F.col("text")).cast("binary"), 256).alias("digest"))
    rows = rows.union(spark.createDataFrame([(k, d) for k, v in DIGESTS.items() for d in v], "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def _held(known: DataFrame, name: str) -> DataFrame:
    return F.broadcast(known.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license"))).alias(name)))


def scan_lines(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", bodies: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, `digest` as of `scan`, `license` and `notices`.

    `license` is that of the whole text by the digest of its `body`, so that titles and ways of wrapping make no
    difference. `notices` are the licences whose digest a whole line or paragraph (text between blank lines) of the text
    has: distinct, in order of name, joined by '; ', null where there are none. Repeated and null ids give a row each;
    null texts have no digest, licence or notice; other columns of the input are not read.
    """
    known = _looked_for(docs.sparkSession) if known is None else known
    bodies = _bodies(docs.sparkSession) if bodies is None else bodies
    text = F.col("text")
    units = F.array_distinct(F.concat(F.split(text, r"\n"), F.split(text, _PARAGRAPH)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).crossJoin(_held(known, "_known"))
    names = F.filter(F.transform(units, lambda x: F.try_element_at(F.col("_known"), digest(x))), lambda x: x.isNotNull())
    out = rows.select("id", digest(text).alias("digest"), F.sha2(body(text).cast("binary"), 256).alias("body"), F.array_join(F.array_sort(F.array_distinct(names)), "; ").alias("notices"))
    # known licences are a table of its own, some dozens of rows unless a larger one is given
    out = out.join(bodies.select(F.col("digest").alias("body"), "license"), "body", "left")
    return out.select(F.col("id").alias(id_col), "digest", "license", F.when(F.col("notices") != "", F.col("notices")).alias("notices"))


def _form(x: str, *dropped: str) -> str:
    """DuckDB's form of canonical, with `dropped` lines out, and of body."""
    for line in dropped:
        x = f"regexp_replace({x}, '{line}', ' ', 'g')"
    out = rf"""' ' || replace(trim(regexp_replace(lower({x}), '{_PUNCTUATION}', ' ', 'g')), ' ', '  ') || ' '"""
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _values(*texts: dict[str, str]) -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for x in texts for k, v in sorted(x.items()))


def _sql_lines() -> str:
    """DuckDB's form of scan_lines over documents."""
    fixed = ", ".join(f"('{k}', '{d}')" for k, v in DIGESTS.items() for d in v)
    line, whole = (_COPYRIGHT_LINE,), (_HOLDER_LINE, _TITLE_LINE)
    return f"""
WITH known AS (SELECT sha256({_form("t", *line)}) AS digest, min(name) AS license FROM (VALUES {_values(KNOWN, NOTICES)}) AS k(name, t) GROUP BY 1),
bodies AS (SELECT body, min(name) AS license FROM (SELECT name, sha256({_form("t", *whole)}) AS body FROM (VALUES {_values(KNOWN, NOTICES, BODIES)}) AS k(name, t) UNION ALL SELECT * FROM (VALUES {fixed}) AS f(name, body)) GROUP BY 1),
u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '{_PARAGRAPH}'))) AS x FROM documents),
n AS (SELECT doc_id, string_agg(DISTINCT license, '; ' ORDER BY license) AS notices FROM (SELECT doc_id, sha256({_form("x", *line)}) AS digest FROM u) JOIN known USING (digest) GROUP BY doc_id),
d AS (SELECT doc_id, sha256({_form("text", *line)}) AS digest, sha256({_form("text", *whole)}) AS body FROM documents)
SELECT d.doc_id, d.digest, bodies.license, n.notices FROM d LEFT JOIN bodies ON d.body = bodies.body LEFT JOIN n ON d.doc_id = n.doc_id
"""


#: DuckDB's form of the query op1.
SQL = _sql_lines()
