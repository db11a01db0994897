import datetime

from scholium.plans import canonical as C
from scholium.sources import acquire, importers, sinks


def test_csv_ris_bibtex_wos(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿UT;TI;AB;PY;SO;AU;DE;DI;TC;CR\nW1;"Machine; learning";abs;2021;J;"Doe, J; Roe, Ann";k1 ;10.1000/a;3;Smith J, 2001, DOI 10.1000/ref.\nW2;Old;;1999;J;;;;x;\n')
    rows = importers.import_file(spark, str(tmp_path / "a.csv"))
    r = {x["URL"]: x for x in rows.collect()}
    assert r["W1"]["title"] == ["Machine; learning"] and r["W1"]["is-referenced-by-count"] == 3 and r["W2"]["is-referenced-by-count"] is None
    assert [a["family"] for a in r["W1"]["author"]] == ["Doe", "Roe"]
    assert r["W1"]["reference"][0]["DOI"] == "10.1000/ref" and r["W1"]["reference"][0]["author"] == "Smith J"
    assert importers.in_protocol(rows, ["machine"], "all", 2020, 2025).count() == 1
    (tmp_path / "b.ris").write_text("TY  - JOUR\nTI  - A title\nAU  - Doe, J\nAU  - Roe, A\nPY  - 2020\nAB  - one\n   two\nER  - \n\nTY  - JOUR\nTI  - Second\nER  - \n")
    ris = importers.import_file(spark, str(tmp_path / "b.ris")).collect()
    assert [x["title"] for x in ris] == [["A title"], ["Second"]] and len(ris[0]["author"]) == 2 and ris[0]["abstract"] == "one two"
    (tmp_path / "c.bib").write_text('@article{key1, title = {A {Nested} title}, author = "Doe, J and Roe, A", year = 2019, doi={10.1000/z}}\n')
    bib = importers.import_file(spark, str(tmp_path / "c.bib")).collect()
    assert bib[0]["title"] == ["A Nested title"] and len(bib[0]["author"]) == 2 and bib[0]["DOI"] == "10.1000/z"
    t = C.crossref(importers.import_file(spark, str(tmp_path / "a.csv")), imported=True)
    assert t["references"].first()["cited_work_id"] == "doi:10.1000/ref" and t["keywords"].first()["keyword_type"] == "imported_keyword"


def test_slices(spark):
    d = datetime.date
    daily = spark.createDataFrame([(d(2024, 1, k), 10) for k in range(1, 9)], "day date, n long")
    slices = acquire.plan_slices(daily, d(2024, 1, 1), d(2024, 1, 8), 20)
    assert sum(s.expected for s in slices) == 80 and all(s.expected <= 20 for s in slices)
    assert all(a.last < b.first for a, b in zip(slices, slices[1:]))
    assert acquire.query_text(["a b", "c"], "any") == '"a b" OR c'


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A", 3, 1), ("b", "B", 5, 1)], "id string, label string, occurrences long, cluster int")
    edges = spark.createDataFrame([("a", "b", 2), ("a", "a", 9), ("a", "x", 1)], "source string, target string, weight long")
    _, network = sinks.vosviewer(nodes, edges)
    assert [tuple(r) for r in network.collect()] == [(1, 2, 2)]
    t = C.canonicalize(spark, [C.crossref(C.synthetic_records(spark, 20))], 2020, 2025)
    row = sinks.bibliometrix(t).orderBy("work_id").first()
    assert row["AU"].count("; ") == 1 and row["CR"].count("; ") == 9
    sinks.write_tables({"works": t["works"]}, str(tmp_path))
    assert sinks.read_tables(spark, str(tmp_path), ["works"])["works"].count() == 20
    assert sinks.file_manifest(spark, str(tmp_path / "works/*.parquet")).count() >= 1
