"""Cases of the review's findings: each failed before its change."""

import random
import textwrap
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from conftest import SF, rows
from ragloom.llm import jaccard, language, licenses, queries


def test_license_lines(spark):
    mit = licenses.KNOWN["MIT"]
    cases = [
        "Was orer.\nThis work is licensed under the GNU General Public License, version 3.\nNext.",
        "One.\r\n  * Released under the MIT Licence\r\nTwo.",
        "Intro.\n\nLicensed under the\nMIT License.\n\nEnd. Licensed under CC BY 4.0.",
        "Some text says it is Licensed under CC BY 4.0. and goes on",
        mit,
        None,
        "",
    ]
    frame = spark.createDataFrame([*enumerate(cases), (0, cases[0])], "doc_id int, text string")
    out = licenses.scan_lines(frame).collect()
    assert len(out) == 8
    found = {r["doc_id"]: (r["license"], r["notices"]) for r in out}
    assert found == {0: (None, "GPL-3.0 notice"), 1: (None, "MIT notice"), 2: (None, "MIT notice"), 3: (None, None), 4: ("MIT", None), 5: (None, None), 6: (None, None)}
    assert licenses.scan_lines(frame.limit(0)).count() == 0


def test_license_lines_of_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = queries.op1_license_scan(spark, SF).where("notices is not null").select("doc_id")
    wanted = docs.where(r"text rlike '(?m)^[^\\n]*[Ll]icense[^\\n]*$'").select("doc_id")
    assert {r[0] for r in labelled.collect()} == {r[0] for r in wanted.collect()} and not labelled.isEmpty()


def test_whole_licenses_wrapped_and_titled(spark):
    wrap = lambda t, n: "\n\n".join("\n".join(textwrap.wrap(p, n)) for p in t.split("\n\n"))
    head = "Copyright (c) 2020 Jane Doe\n\n"
    texts = licenses.KNOWN | licenses.BODIES
    cases = {}
    for name, title in {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": 'BSD 3-Clause "New" or "Revised" License'}.items():
        for n in range(40, 100, 7):
            cases[f"{title}\n\n{head}{wrap(texts[name], n)}"] = name
        cases[f"The {title}\r\n\r\nCopyright Jane Doe\r\nAll rights reserved.\r\n" + wrap(texts[name], 78).upper().replace("\n", "\r\n")] = name
    isc = texts["ISC"].replace("above copyright", "above\ncopyright")
    cases |= {"ISC License\n\n" + isc: "ISC", "MIT License": None, "MIT License\n" + head: None, texts["MIT"] + " but not for Jane.": None}
    for name in ("Apache-2.0", "GPL-3", "MPL-2.0"):
        if (file := Path("/usr/share/common-licenses", name)).exists():
            cases[file.read_text()] = {"GPL-3": "GPL-3.0"}.get(name, name)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    found = licenses.scan_lines(frame)
    assert {r["doc_id"]: r["license"] for r in found.collect()} == dict(enumerate(cases.values()))
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    assert rows(found.toPandas()) == rows(con.sql(licenses.SQL).df())


def links(texts):
    """Brute force: the number of other texts that each text links to."""
    split = [(t or "").split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    return [sum(i != j and bool(a and b) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


def family(n, seed=5):
    """Near copies of one text, with 1 to 6 words changed, some of them twice, and other texts."""
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(90)]
    out = []
    for k in range(n):
        w = list(base)
        for at in draw.sample(range(90), 1 + k % 6):
            w[at] = f"e{k}x{at}"
        out.append(" ".join(w))
    return [*out, *out[:4], " ".join(base), "quite another text of seven words", "", "a b", "a b", *(f"other{k} " * 9 for k in range(3))]


def test_links_counted(spark, monkeypatch):
    for n, block, rounds in ((40, 128, 256), (60, 9, 16)):
        monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
        monkeypatch.setattr(jaccard, "GROUP_ROWS", rounds)
        texts = family(n)
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        found = {r["doc_id"]: r["n_links"] for r in jaccard.similar_classes(frame).collect()}
        wanted = links(texts)
        assert found == dict(enumerate(wanted)) and max(wanted) > 15 and len(set(wanted)) > 5


def test_language_rejects_the_unlearned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("octet_length(text) >= 64")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.learnt(docs.where(~held))
    draw = random.Random(2)
    noise = [" ".join("".join(draw.choice(a) for _ in range(draw.randint(3, 9))) for _ in range(60)) for a in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef")]
    noise.append("Suomi on tasavalta Pohjois-Euroopassa ja sen pääkaupunki on Helsinki. Maassa on tuhansia järviä, joiden rannoilla ihmiset viettävät kesäisin lomaa, uivat, kalastavat ja saunovat myöhään yöhön asti.")
    frame = spark.createDataFrame(list(enumerate(noise)), "doc_id int, text string")
    assert all(r["rejected"] for r in language.identify(frame, model).collect())
    clean = [r["rejected"] for r in language.identify(docs.where(held), model).collect()]
    print("lost", sum(clean), "of", len(clean), model.languages, model.floor)
    assert sum(clean) <= 0.03 * len(clean)


def test_one_row_of_each_component(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    cases = [(1, a), (1, a), (1, b), (2, b + " tail"), (3, a + " tail"), (None, "alone " * 9), (None, a), (None, b), (4, ""), (4, ""), (None, None)]
    frame = spark.createDataFrame(cases, "doc_id long, text string").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.first_of_each(frame).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, "alone " * 9), (4, ""), (4, ""), (None, None)], key=str)
