"""File imports (CSV/TSV, JSONL, RIS, BibTeX, WoS) mapped to the Crossref-like staging shape."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scholium.functions.text import split_list, year_of
from scholium.schema import CROSSREF

# Header names of common exports, first match wins.
ALIASES = {
    "title": "TI|Title|Document Title|Article Title",
    "abstract": "AB|Abstract|Abstract Note",
    "year": "PY|Year|Publication Year|Y1",
    "doi": "DI|DOI|Digital Object Identifier",
    "container": "SO|Source title|Publication Name|Journal|JF|JO",
    "authors": "AU|Authors|Author|Author(s)",
    "keywords": "DE|Author Keywords|Keywords|KW",
    "index_keywords": "ID|Index Keywords|Keywords Plus",
    "references": "CR|References|Cited References",
    "affiliations": "C1|Affiliations|Author Address",
    "issn": "SN|ISSN",
    "cited": "TC|Cited by|Times Cited|is-referenced-by-count",
    "reference_count": "NR|References Count|references-count",
    "record_id": "UT|EID|Accession Number|URL|UR",
    "publisher": "PU|Publisher",
    "type": "DT|Document Type|Type|TY",
    "language": "LA|Language|Language of Original Document",
    "volume": "VL|Volume",
    "issue": "IS|Issue",
    "page": "Pages|Page start|BP|SP",
}
RIS_TAGS = {"T1": "TI", "A1": "AU", "AU": "AU", "DO": "DI", "JF": "SO", "JO": "SO", "T2": "SO", "N2": "AB", "KW": "DE", "PB": "PU", "UR": "UT", "ID": "UT"}
BIBTEX_FIELDS = {"title": "TI", "abstract": "AB", "year": "PY", "doi": "DI", "journal": "SO", "booktitle": "SO", "author": "AU", "keywords": "DE", "issn": "SN", "publisher": "PU", "volume": "VL", "number": "IS", "pages": "Pages", "url": "UR"}


def read_delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """CSV or TSV with a header, all strings; the delimiter is sniffed from the header line, a byte-order mark ignored."""
    if separator is None:
        head = spark.read.text(path).limit(1).collect()
        line = (head[0][0] if head else "").lstrip("﻿")
        try:
            separator = csv.Sniffer().sniff(line, ",;\t|").delimiter
        except csv.Error:
            separator = "\t" if "\t" in line else ","
    df = spark.read.csv(path, header=True, sep=separator, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def tagged_records(lines: list[str], end: str) -> Iterator[dict[str, str]]:
    """Records of two-letter tags: repeated tags joined by '; ', continuation lines appended, ``end`` closes."""
    record: dict[str, list[str]] = {}
    tag = None
    for line in lines:
        m = re.match(r"^([A-Z][A-Z0-9])(?:\s{1,2}-\s?|\s|$)(.*)$", line.lstrip("﻿"))
        if m and m[1] == end:
            if record:
                yield {k: "; ".join(v) for k, v in record.items()}
            record, tag = {}, None
        elif m:
            tag = m[1]
            record.setdefault(tag, []).append(m[2].strip())
        elif tag and line.strip():
            record[tag][-1] = f"{record[tag][-1]} {line.strip()}".strip()
    if record:
        yield {k: "; ".join(v) for k, v in record.items()}


def bibtex_records(text: str) -> Iterator[dict[str, str]]:
    """Entries of a BibTeX text; braces are matched by depth, ``and`` between authors becomes '; '."""
    for m in re.finditer(r"@(\w+)\s*\{", text):
        if m[1].lower() in ("comment", "preamble", "string"):
            continue
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        body, entry = text[m.end() : at - 1], {"TY": m[1].lower()}
        key, _, fields = body.partition(",")
        entry["UT"] = key.strip()
        for f in re.finditer(r"(\w+)\s*=\s*", fields):
            if fields[: f.start()].count("{") != fields[: f.start()].count("}"):
                continue
            rest = fields[f.end() :]
            if rest[:1] == "{":
                depth, k = 0, 0
                for k, ch in enumerate(rest):
                    depth += {"{": 1, "}": -1}.get(ch, 0)
                    if not depth:
                        break
                value = rest[1:k]
            elif rest[:1] == '"':
                value = rest[1:].split('"', 1)[0]
            else:
                value = rest.split(",", 1)[0]
            value = re.sub(r"\s+", " ", value.replace("{", "").replace("}", "")).strip()
            name = BIBTEX_FIELDS.get(f[1].lower())
            if name:
                entry[name] = re.sub(r"\s+and\s+", "; ", value) if name == "AU" else value
        yield entry


def _from_files(spark: SparkSession, path: str, parse) -> DataFrame:
    """One row of a tag -> value map per record; a file is the unit, as records span lines."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"fields": [r for text in batch["value"] for r in parse(text)]}, columns=["fields"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "fields map<string,string>")


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    def parse(text: str):
        for r in tagged_records(text.splitlines(), "ER"):
            out: dict[str, str] = {}
            for k, v in r.items():
                name = RIS_TAGS.get(k, k)
                out[name] = f"{out[name]}; {v}" if name in out and name in ("AU", "DE") else out.get(name, v)
            yield out

    return _from_files(spark, path, parse)


def read_wos(spark: SparkSession, path: str) -> DataFrame:
    return _from_files(spark, path, lambda text: tagged_records(text.splitlines(), "ER"))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    return _from_files(spark, path, bibtex_records)


def read_jsonl(spark: SparkSession, path: str, schema: str = CROSSREF) -> DataFrame:
    """JSON lines (also gzip) with a stated schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_pages(spark: SparkSession, path: str, items: str) -> DataFrame:
    """Raw JSON response pages, exploded to their items."""
    pages = spark.read.option("multiLine", True).json(path)
    return pages.select(F.explode(F.col(items)).alias("item")).select("item.*")


def _author(name: Column) -> Column:
    comma = F.contains(name, F.lit(","))
    parts = F.split(F.trim(name), r"\s+")
    family = F.when(comma, F.trim(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(F.element_at(parts, -1))
    given = F.when(comma, F.trim(F.regexp_replace(name, "^[^,]*,", ""))).otherwise(F.array_join(F.slice(parts, 1, F.size(parts) - 1), " "))
    return F.struct(F.nullif(given, F.lit("")).alias("given"), F.nullif(family, F.lit("")).alias("family"))


def _reference(text: Column) -> Column:
    doi = F.nullif(F.regexp_replace(F.regexp_extract(text, r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1), r"[.,;)]+$", ""), F.lit(""))
    return F.struct(doi.alias("DOI"), F.lit(None).cast("string").alias("article-title"), F.nullif(F.trim(F.split_part(text, F.lit(","), F.lit(1))), F.lit("")).alias("author"), year_of(text).cast("string").alias("year"), text.alias("unstructured"))


def staged(rows: DataFrame) -> DataFrame:
    """Rows of aliased columns, or of a ``fields`` map, in the shape of :data:`scholium.schema.CROSSREF`."""
    if rows.columns == ["fields"]:
        low = F.transform_keys("fields", lambda k, _: F.lower(F.trim(k)))
        rows = rows.select(low.alias("f"))

        def value(name: str) -> Column:
            return F.try_element_at("f", F.lit(name.lower()))
    else:
        held = {c.strip().lower(): c for c in rows.columns}

        def value(name: str) -> Column:
            return F.col(f"`{held[name.lower()]}`") if name.lower() in held else F.lit(None).cast("string")

    def first(field: str) -> Column:
        return F.coalesce(*[F.nullif(value(n), F.lit("")) for n in ALIASES[field].split("|")])

    flat = rows.select(*[first(f).alias(f) for f in ALIASES])
    number = {c: F.when(F.col(c).rlike(r"^\d+(\.\d+)?$"), F.floor(F.col(c).try_cast("double"))) for c in ("cited", "reference_count")}
    people = split_list(F.col("authors"))
    places = F.transform(split_list(F.col("affiliations")), lambda x: F.struct(x.alias("name")))
    author = F.transform(people, lambda p, i: F.struct(_author(p)["given"].alias("given"), _author(p)["family"].alias("family"), F.lit(None).cast("string").alias("ORCID"), F.when(i == 0, places).otherwise(F.slice(places, 1, 0)).alias("affiliation")))
    refs = split_list(F.col("references"), r";|\n")
    year = year_of(F.col("year"))
    made = {
        "DOI": F.col("doi"), "URL": F.coalesce("record_id", F.concat(F.lit("import-row:"), F.sha1(F.to_json(F.struct("*"))))), "title": F.when(F.col("title").isNotNull(), F.array("title")), "abstract": F.col("abstract"),
        "published": F.when(year.isNotNull(), F.struct(F.array(F.array(year.cast("int"))).alias("date-parts"))), "container-title": F.when(F.col("container").isNotNull(), F.array("container")), "author": author,
        "subject": F.array_distinct(F.concat(split_list(F.col("keywords")), split_list(F.col("index_keywords")))), "reference": F.transform(refs, _reference), "ISSN": split_list(F.col("issn"), r";|\||,"),
        "publisher": F.col("publisher"), "type": F.col("type"), "language": F.col("language"), "volume": F.col("volume"), "issue": F.col("issue"), "page": F.col("page"), "is-referenced-by-count": number["cited"], "references-count": F.coalesce(number["reference_count"], F.size(refs)),
    }
    shape = StructType.fromDDL(CROSSREF)
    return flat.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])


def in_protocol(records: DataFrame, terms: list[str], mode: str, first: int, last: int) -> DataFrame:
    """Records of the year range whose title, abstract or subjects hold the terms: ``all``, ``any`` or as one ``phrase``."""
    text = F.lower(F.concat_ws(" ", F.array_join("title", " "), "abstract", F.array_join("subject", " ")))
    hits = [F.contains(text, F.lit(t.lower())) for t in ([" ".join(terms)] if mode == "phrase" else terms)]
    match = reduce((lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b), hits, F.lit(mode != "any" or not hits))
    year = F.col("published.`date-parts`")[0][0]
    return records.filter(match & year.between(first, last))


IMPORTERS = {"csv": read_delimited, "tsv": read_delimited, "ris": read_ris, "bib": read_bibtex, "wos": read_wos, "txt": read_wos}


def import_file(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Staged records of a file by its suffix or ``kind``."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind in ("jsonl", "json", "gz"):
        return read_jsonl(spark, path)
    return staged(IMPORTERS[kind](spark, path))
