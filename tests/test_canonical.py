import json

from pyspark.sql import functions as F

from scholium.plans import canonical as C
from scholium.schema import CROSSREF, EUROPE_PMC, OPENALEX
from scholium.streaming.ingest import ingest


def crossref_rows(n, **extra):
    out = []
    for i in range(n):
        out.append({
            "DOI": f"10.1000/work{i}", "title": [f"A study of collaborative knowledge systems part {i}"], "published": {"date-parts": [[2020 + i % 6]]}, "type": "journal-article",
            "container-title": [f"Journal {i % 2}"], "author": [{"given": "G", "family": f"F{i % 5}", "affiliation": [{"name": "University of A"}]}, {"given": "H", "family": f"F{(i + 1) % 5}", "affiliation": []}],
            "subject": ["Topic one", f"Topic {i % 3}"], "reference": [{"DOI": f"10.2000/ref{(i + k) % 6}", "year": "2018"} for k in range(3)], "references-count": 3, "is-referenced-by-count": 2 * i,
        } | extra)
    return out


def frame(spark, tmp_path, rows, schema, name="r"):
    path = tmp_path / f"{name}.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return spark.read.schema(schema).json(str(path))


def test_crossref_counts(spark, tmp_path):
    t = C.canonicalize(spark, [C.crossref(frame(spark, tmp_path, crossref_rows(18), CROSSREF))], 2020, 2025)
    assert t["works"].count() == 18
    assert t["authorships"].count() == 36
    assert t["references"].select("cited_work_id").distinct().count() == 6
    assert t["keywords"].select("work_id").distinct().count() == 18
    gate = C.quality_gate(t, 18, 2020, 2025).collect()
    assert [r for r in gate if not r["passed"]] == []


def test_duplicates_scope_and_conservation(spark, tmp_path):
    first = crossref_rows(20)
    twin = [{k: v for k, v in first[3].items() if k != "DOI"} for _ in range(2)]
    twin[1] = dict(twin[1], author=[{"given": "Z", "family": "Other", "affiliation": []}], reference=[{"DOI": "10.9/new9999", "year": "2001"}, {"DOI": "10.9999/new", "year": "2001"}])
    late = [dict(crossref_rows(1)[0], DOI="10.1000/late", published={"date-parts": [[2030]]}), dict(crossref_rows(1)[0], DOI="10.1000/undated", published=None)]
    parts = [C.crossref(frame(spark, tmp_path, rows, CROSSREF, f"p{k}")) for k, rows in enumerate((first, twin, late))]
    t = C.canonicalize(spark, parts, 2020, 2025)
    assert t["works"].count() == 21
    merged = [r["removed_work_id"] for r in t["duplicates"].collect()]
    assert len(merged) == 1
    winner = t["duplicates"].first()["kept_work_id"]
    assert t["provenance"].filter(F.col("work_id") == winner).count() == 2
    assert "doi:10.9999/new" in {r["cited_work_id"] for r in t["references"].filter(F.col("citing_work_id") == winner).collect()}
    assert sorted(r["rule"] for r in t["excluded_records"].collect()) == ["after_scope", "missing_year"]
    assert t["provenance"].count() + t["excluded_records"].count() == 24


def test_openalex_unknown_authors_are_occurrences(spark, tmp_path):
    people = [{"author": {"id": i, "display_name": "Same Name"}} for i in (None, "", "None", "https://openalex.org/None")]
    rows = [{"id": f"https://openalex.org/W{k}", "title": "T", "publication_year": 2021, "authorships": people[2 * k : 2 * k + 2], "abstract_inverted_index": {"b": [1], "a": [0]}} for k in range(2)]
    t = C.openalex(frame(spark, tmp_path, rows, OPENALEX))
    assert t["authors"].select("author_id").distinct().count() == 4
    assert {r["abstract"] for r in t["works"].collect()} == {"a b"}
    known = [{"id": "https://openalex.org/W9", "authorships": [{"author": {"id": "https://openalex.org/A1", "orcid": "https://orcid.org/0000-0001-2345-6789"}}, {"author": {"id": "https://openalex.org/A2"}}]}]
    ids = {r["author_id"] for r in C.openalex(frame(spark, tmp_path, known, OPENALEX, "k"))["authors"].collect()}
    assert ids == {"orcid:0000-0001-2345-6789", "openalex-author:A2"}


def test_europe_pmc(spark, tmp_path):
    rows = [{"id": "1", "source": "MED", "title": "T", "pubYear": "2020", "pubTypeList": {"pubType": ["Review", "Journal Article"]}, "authorList": {"author": [{"fullName": "A B", "authorIdList": {"authorId": [{"type": "ORCID", "value": "0000-0001-2345-6789"}]}}]}, "keywordList": {"keyword": ["humans", "gene editing"]}, "hasReferences": "Y", "_references": [{"source": "MED", "id": "7"}, {"title": "x"}]}]
    t = C.europe_pmc(frame(spark, tmp_path, rows, EUROPE_PMC))
    w = t["works"].first()
    assert (w["work_id"], w["document_type"], w["reference_count"], w["year"]) == ("epmc:MED:1", "Review", 2, 2020)
    assert [r["keyword"] for r in t["keywords"].collect()] == ["Gene editing"]
    assert t["authors"].first()["author_id"] == "orcid:0000-0001-2345-6789"
    assert "epmc:MED:7" in {r["cited_work_id"] for r in t["references"].collect()}


def test_micro_batches_resume(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = crossref_rows(9)
    for k in range(2):
        (source / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[3 * k : 3 * k + 3]))

    def run():
        ingest(spark, str(source), CROSSREF, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: {"works": C.crossref(b)["works"]}).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out/works")).count()

    assert run() == 6
    (source / "2.json").write_text("\n".join(json.dumps(r) for r in rows[6:]))
    assert run() == 9


def test_scope_audit(spark):
    m = spark.createDataFrame([("w1", "A"), ("w1", "B"), ("w1", "C"), ("w2", "A"), ("w2", "B"), ("w2", "B")], "w string, i string")
    r = C.scope_audit(m, spark.createDataFrame([("A",), ("B",)], "i string"), "w", "i").first()
    assert (r["rows"], r["mass"], r["items"]) == (5, 4, 3)
    assert (r["mass_share"], r["membership_share"], round(r["item_share"], 6)) == (0.5, 0.8, 0.666667)
