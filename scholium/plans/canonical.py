"""Canonicalization: nested records to ten tables, global de-duplication, remapping, ledger, quality gate.

Flattening is declarative (struct access, explode); the winner of each dedup key is one
window over key-partitioned rows, and relations follow their works over a one-hop id map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators.aggregates import filled
from scholium.schema import TABLES
from scholium.session import cut

def shaped(df: DataFrame, table: str) -> DataFrame:
    """Exactly the table's columns and types; missing ones null, bad values null."""
    held = {c.lower(): c for c in df.columns}
    out = []
    for item in TABLES[table].split(", "):
        name, kind = item.split(" ")
        out.append((F.col(f"`{held[name.lower()]}`").try_cast(kind) if name.lower() in held else F.lit(None).cast(kind)).alias(name))
    return df.select(*out)


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _tail(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def _hash(df: DataFrame) -> DataFrame:
    return df.withColumn("_hash", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256))


def _tables(rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    spark = next(iter(rows.values())).sparkSession
    return {t: shaped(rows[t], t) if t in rows else spark.createDataFrame([], s) for t, s in TABLES.items()}


def crossref(records: DataFrame, imported: bool = False) -> dict[str, DataFrame]:
    """Flatten records of :data:`scholium.schema.CROSSREF`."""
    source = "import_file" if imported else "crossref"
    year, date = T.date_parts(*[F.col(f"`{k}`.`date-parts`") for k in ("published", "issued", "published-online", "published-print", "created")])
    container, doi = T.clean_text(_first(F.col("`container-title`"))), T.normalize_doi(F.col("DOI"))
    base = _hash(records).withColumns({"_doi": doi, "_title": T.clean_text(_first(F.col("title"))), "_year": year, "_date": date, "_container": container, "_publisher": T.clean_text(F.col("publisher"))})
    fallback = T.stable_id("work", T.normalize_title(F.col("_title")), F.col("_year"), _first(F.col("author"))["family"])
    issn = F.when(F.size("ISSN") > 0, F.concat(F.lit("issn:"), F.lower(F.array_min("ISSN"))))
    base = base.withColumns({"work_id": F.when(F.col("_doi").isNotNull(), F.concat(F.lit("doi:"), "_doi")).otherwise(fallback), "source_id": F.coalesce(issn, T.stable_id("source", F.col("_container")))})
    works = base.select(
        "work_id", F.col("_doi").alias("doi"), F.col("URL").alias("external_id"), F.col("_title").alias("title"), T.clean_text(F.col("abstract")).alias("abstract"), F.col("_year").alias("year"), F.col("_date").alias("publication_date"),
        F.col("type").alias("document_type"), "language", "source_id", "volume", "issue", F.col("page").alias("pages"), F.col("_publisher").alias("publisher"), F.col("`is-referenced-by-count`").alias("cited_by_count"),
        F.col("`references-count`").alias("reference_count"), (F.coalesce(F.size("update-to"), F.lit(0)) > 0).alias("is_retracted"), F.col("_hash").alias("source_record_hash"),
    )
    sources = base.select("source_id", F.col("_container").alias("name"), F.nullif(F.array_join("ISSN", "|"), F.lit("")).alias("issn"), F.col("_publisher").alias("publisher"), F.col("type").alias("source_type"))
    people = base.select("work_id", F.posexplode("author").alias("pos", "a")).withColumns({"full": T.clean_text(F.nullif(F.concat_ws(" ", F.nullif(F.col("a.given"), F.lit("")), F.nullif(F.col("a.family"), F.lit(""))), F.lit(""))), "orcid": T.normalize_orcid(F.col("a.ORCID"))})
    author_id = F.when(F.col("orcid").isNotNull(), F.concat(F.lit("orcid:"), "orcid")).otherwise(T.stable_id("author", F.col("full"), T.normalize_affiliation(_first(F.col("a.affiliation"))["name"])))
    people = people.withColumn("author_id", author_id)
    places = people.select("work_id", "author_id", (F.col("pos") + 1).alias("position"), F.explode_outer("a.affiliation").alias("f")).withColumn("name", T.normalize_affiliation(F.col("f.name")))
    places = places.withColumn("institution_id", F.when(F.col("name").isNotNull(), T.stable_id("institution", F.col("name"))))
    subjects = base.select("work_id", F.explode("subject").alias("k")).select("work_id", T.clean_text(F.col("k")).alias("keyword"), F.lit("imported_keyword" if imported else "crossref_subject").alias("keyword_type"))
    cited = base.select("work_id", F.explode("reference").alias("r")).withColumns({"cd": T.normalize_doi(F.col("r.DOI")), "ct": T.clean_text(F.col("r.`article-title`"))})
    cited_id = F.when(F.col("cd").isNotNull(), F.concat(F.lit("doi:"), "cd")).otherwise(T.stable_id("reference", F.col("ct"), F.col("r.year"), F.col("r.author")))
    return _tables({
        "works": works, "sources": sources,
        "authors": people.select("author_id", F.col("full").alias("name"), T.clean_text(F.col("a.given")).alias("given_name"), T.clean_text(F.col("a.family")).alias("family_name"), "orcid"),
        "authorships": places.select("work_id", "author_id", "institution_id", "position", F.lit(False).alias("is_corresponding")),
        "institutions": places.filter("name IS NOT NULL").select("institution_id", "name"),
        "keywords": subjects.filter("keyword IS NOT NULL"),
        "references": cited.select(F.col("work_id").alias("citing_work_id"), cited_id.alias("cited_work_id"), F.col("cd").alias("cited_doi"), F.col("ct").alias("cited_title"), T.clean_text(F.col("r.author")).alias("cited_author"), F.col("r.year").alias("cited_year"), F.lit(source).alias("source")),
        "provenance": base.select("work_id", F.lit(source).alias("source"), F.coalesce("_doi", "URL").alias("source_record_id"), F.col("_hash").alias("source_record_hash")),
    })


def openalex(records: DataFrame) -> dict[str, DataFrame]:
    """Flatten records of :data:`scholium.schema.OPENALEX`; an author without an identity is an occurrence, never merged by name."""
    base = _hash(records).withColumns({"_doi": T.normalize_doi(F.col("doi")), "_s": F.col("primary_location.source")})
    base = base.withColumns({
        "work_id": F.when(F.col("_doi").isNotNull(), F.concat(F.lit("doi:"), "_doi")).otherwise(F.concat(F.lit("openalex:"), F.coalesce(_tail(F.col("id")), F.lit("")))),
        "source_id": F.when(F.col("_s.issn_l").isNotNull(), F.concat(F.lit("issn:"), F.col("_s.issn_l"))).otherwise(F.concat(F.lit("openalex-source:"), F.coalesce(_tail(F.col("_s.id")), F.lit("")))),
    })
    works = base.select(
        "work_id", F.col("_doi").alias("doi"), F.col("id").alias("external_id"), T.clean_text(F.coalesce(F.nullif("title", F.lit("")), "display_name")).alias("title"), T.clean_text(T.inverted_abstract(F.col("abstract_inverted_index"))).alias("abstract"),
        F.col("publication_year").alias("year"), "publication_date", F.col("type").alias("document_type"), "language", "source_id", F.col("biblio.volume").alias("volume"), F.col("biblio.issue").alias("issue"), F.col("biblio.first_page").alias("pages"),
        T.clean_text(F.col("_s.host_organization_name")).alias("publisher"), "cited_by_count", F.col("referenced_works_count").alias("reference_count"), F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"), F.col("_hash").alias("source_record_hash"),
    )
    people = base.select("work_id", F.posexplode("authorships").alias("pos", "a")).withColumns({"orcid": T.normalize_orcid(F.col("a.author.orcid")), "ext": _tail(F.trim(F.coalesce(F.col("a.author.id"), F.lit(""))))})
    known = ~F.lower("ext").isin("", "none", "null", "nan")
    author_id = F.when(F.col("orcid").isNotNull(), F.concat(F.lit("orcid:"), "orcid")).when(known, F.concat(F.lit("openalex-author:"), "ext")).otherwise(T.stable_id("openalex-author-occurrence", F.col("work_id"), F.col("pos") + 1))
    people = people.withColumn("author_id", author_id)
    places = people.select("work_id", "author_id", (F.col("pos") + 1).alias("position"), F.coalesce("a.is_corresponding", F.lit(False)).alias("is_corresponding"), F.explode_outer("a.institutions").alias("i"))
    place_id = F.when(F.col("i.ror").isNotNull(), F.concat(F.lit("ror:"), _tail(F.col("i.ror")))).when(F.col("i").isNotNull(), F.concat(F.lit("openalex-institution:"), F.coalesce(_tail(F.col("i.id")), F.lit(""))))
    places = places.withColumn("institution_id", place_id)
    return _tables({
        "works": works,
        "sources": base.select("source_id", T.clean_text(F.col("_s.display_name")).alias("name"), F.nullif(F.array_join("_s.issn", "|"), F.lit("")).alias("issn"), T.clean_text(F.col("_s.host_organization_name")).alias("publisher"), F.col("_s.type").alias("source_type")),
        "authors": people.select("author_id", T.clean_text(F.col("a.author.display_name")).alias("name"), "orcid"),
        "authorships": places.select("work_id", "author_id", "institution_id", "position", "is_corresponding"),
        "institutions": places.filter("i IS NOT NULL").select("institution_id", T.clean_text(F.col("i.display_name")).alias("name"), F.col("i.ror").alias("ror"), F.col("i.country_code").alias("country_code")),
        "keywords": base.select("work_id", F.explode("keywords").alias("k")).select("work_id", T.clean_text(F.col("k.display_name")).alias("keyword"), F.lit("openalex").alias("keyword_type")).filter("keyword IS NOT NULL"),
        "topics": base.select("work_id", F.explode("topics").alias("t")).select("work_id", F.col("t.id").alias("topic_id"), T.clean_text(F.col("t.display_name")).alias("topic"), F.col("t.score").alias("score"), T.clean_text(F.col("t.field.display_name")).alias("field")),
        "references": base.select("work_id", F.explode("referenced_works").alias("r")).select(F.col("work_id").alias("citing_work_id"), F.concat(F.lit("openalex:"), _tail(F.col("r"))).alias("cited_work_id"), F.lit("openalex").alias("source")),
        "provenance": base.select("work_id", F.lit("openalex").alias("source"), F.col("id").alias("source_record_id"), F.col("_hash").alias("source_record_hash")),
    })


def europe_pmc(records: DataFrame) -> dict[str, DataFrame]:
    """Flatten records of :data:`scholium.schema.EUROPE_PMC`."""
    base = _hash(records).withColumns({"_doi": T.normalize_doi(F.col("doi")), "_ext": F.concat_ws(":", "source", "id"), "_j": F.col("journalInfo.journal")})
    base = base.withColumns({"work_id": F.when(F.col("_doi").isNotNull(), F.concat(F.lit("doi:"), "_doi")).otherwise(F.concat(F.lit("epmc:"), "_ext")), "source_id": F.when(F.col("_j.issn").isNotNull(), F.concat(F.lit("issn:"), F.col("_j.issn"))).otherwise(T.stable_id("source", F.col("_j.title")))})
    count = F.when(F.col("hasReferences") == "Y", F.coalesce(F.size("_references"), F.lit(0))).otherwise(0)
    works = base.select(
        "work_id", F.col("_doi").alias("doi"), F.col("_ext").alias("external_id"), T.clean_text(F.col("title")).alias("title"), T.clean_text(F.col("abstractText")).alias("abstract"), F.when(F.col("pubYear").rlike(r"^\d+$"), F.col("pubYear")).alias("year"), F.col("firstPublicationDate").alias("publication_date"),
        T.normalize_document_type(F.col("pubTypeList.pubType")).alias("document_type"), "language", "source_id", F.col("journalInfo.volume").alias("volume"), F.col("journalInfo.issue").alias("issue"), F.col("pageInfo").alias("pages"), F.col("citedByCount").alias("cited_by_count"),
        F.greatest(count, F.lit(0)).alias("reference_count"), F.coalesce("isRetracted", F.lit(False)).alias("is_retracted"), F.col("_hash").alias("source_record_hash"),
    )
    people = base.select("work_id", F.posexplode("authorList.author").alias("pos", "a"))
    ids = F.filter("a.authorIdList.authorId", lambda x: F.upper(x["type"]) == "ORCID")
    people = people.withColumns({"full": T.clean_text(F.col("a.fullName")), "orcid": T.normalize_orcid(_first(ids)["value"])})
    people = people.withColumn("author_id", F.when(F.col("orcid").isNotNull(), F.concat(F.lit("orcid:"), "orcid")).otherwise(T.stable_id("author", F.col("full"))))
    places = people.select("work_id", "author_id", (F.col("pos") + 1).alias("position"), F.explode_outer("a.authorAffiliationDetailsList.authorAffiliation").alias("f")).withColumn("name", T.normalize_affiliation(F.col("f.affiliation")))
    places = places.withColumn("institution_id", F.when(F.col("name").isNotNull(), T.stable_id("institution", F.col("name"))))
    mesh = base.select("work_id", F.explode("meshHeadingList.meshHeading").alias("k")).select("work_id", T.normalize_keyword(F.col("k.descriptorName")).alias("keyword"), F.lit("mesh").alias("keyword_type"))
    own = base.select("work_id", F.explode("keywordList.keyword").alias("k")).select("work_id", T.normalize_keyword(F.col("k")).alias("keyword"), F.lit("author").alias("keyword_type"))
    cited = base.select("work_id", F.explode("_references").alias("r")).withColumn("cd", T.normalize_doi(F.col("r.doi")))
    external = F.when(F.col("r.source").isNotNull() & F.col("r.id").isNotNull(), F.concat(F.lit("epmc:"), F.col("r.source"), F.lit(":"), F.col("r.id")))
    cited_id = F.coalesce(F.concat(F.lit("doi:"), "cd"), external, T.stable_id("reference", F.col("r.title"), F.col("r.authorString"), F.col("r.pubYear")))
    return _tables({
        "works": works,
        "sources": base.select("source_id", T.clean_text(F.col("_j.title")).alias("name"), F.col("_j.issn").alias("issn"), F.lit("journal").alias("source_type")),
        "authors": people.select("author_id", F.col("full").alias("name"), T.clean_text(F.col("a.firstName")).alias("given_name"), T.clean_text(F.col("a.lastName")).alias("family_name"), "orcid"),
        "authorships": places.select("work_id", "author_id", "institution_id", "position", F.lit(False).alias("is_corresponding")),
        "institutions": places.filter("name IS NOT NULL").select("institution_id", "name"),
        "keywords": mesh.unionByName(own).filter("keyword IS NOT NULL"),
        "references": cited.select(F.col("work_id").alias("citing_work_id"), cited_id.alias("cited_work_id"), F.col("cd").alias("cited_doi"), T.clean_text(F.col("r.title")).alias("cited_title"), T.clean_text(F.col("r.authorString")).alias("cited_author"), F.col("r.pubYear").alias("cited_year"), F.lit("europe_pmc").alias("source")),
        "provenance": base.select("work_id", F.lit("europe_pmc").alias("source"), F.col("_ext").alias("source_record_id"), F.col("_hash").alias("source_record_hash")),
    })


COMPLETENESS = ["doi", "title", "abstract", "year", "publication_date", "document_type", "language", "source_id", "publisher", "cited_by_count", "reference_count"]


def ranked_works(works: DataFrame) -> DataFrame:
    """Works with dedup key, winner of the key and rank within it: most complete, then record hash, then id."""
    title = T.normalize_title(F.col("title"))
    key = F.when(filled(F.col("doi")), F.concat(F.lit("doi:"), "doi")).when(F.length(title) >= 20, T.stable_id("dedup", title, F.col("year"))).otherwise(F.concat(F.lit("record:"), F.coalesce("source_record_hash", "work_id")))
    rows = works.withColumn("_dedup_key", key).withColumn("_completeness_score", T.completeness(COMPLETENESS))
    order = Window.partitionBy("_dedup_key").orderBy(F.desc("_completeness_score"), F.asc_nulls_last("source_record_hash"), F.asc_nulls_last("work_id"))
    return rows.withColumns({"_kept": F.first("work_id").over(order), "_rank": F.row_number().over(order)})


def best_rows(rows: DataFrame, key: str, name: str = "name") -> DataFrame:
    """The most complete row of each entity, ties by name and then by the other columns."""
    others = [c for c in rows.columns if c != key]
    order = Window.partitionBy(key).orderBy(F.desc(T.completeness(others)), F.asc_nulls_last(name), *[F.asc_nulls_last(c) for c in others if c != name])
    return rows.filter(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def canonicalize(spark: SparkSession, parts: list[dict[str, DataFrame]], year_from: int, year_to: int) -> dict[str, DataFrame]:
    """The ten canonical tables and ``excluded_records`` of partition tables, de-duplicated over all of them.

    Winners are chosen before the year scope; losers' relations move to the winner; works out of scope go to the ledger.
    """
    merged = {t: parts[0][t] for t in TABLES}
    for p in parts[1:]:
        merged = {t: merged[t].unionByName(p[t], allowMissingColumns=True) for t in TABLES}
    ranked = cut(spark, ranked_works(merged["works"]))
    winners = ranked.filter("_rank = 1")
    inside = winners.filter(F.col("year").between(year_from, year_to))
    kept = cut(spark, inside.select("work_id").distinct())
    # One hop, the smallest winner on conflict.
    mapping = cut(spark, ranked.filter("work_id <> _kept").groupBy(F.col("work_id").alias("old")).agg(F.min("_kept").alias("new")))

    def remapped(df: DataFrame, column: str) -> DataFrame:
        to = mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
        return df.join(to, df[column] == to["__old"], "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")

    def of_kept(df: DataFrame, column: str = "work_id") -> DataFrame:
        ids = kept.select(F.col("work_id").alias("__kept"))
        return df.join(ids, df[column] == ids["__kept"], "left_semi")

    works = shaped(inside, "works")
    relations = {t: of_kept(remapped(merged[t], "work_id")).distinct() for t in ("authorships", "keywords", "topics", "provenance")}
    cited = of_kept(remapped(remapped(merged["references"], "citing_work_id"), "cited_work_id"), "citing_work_id")
    attributes = ["cited_doi", "cited_title", "cited_author", "cited_year", "source"]
    order = Window.partitionBy("citing_work_id", "cited_work_id").orderBy(F.desc(T.completeness(attributes[:4])), *[F.asc_nulls_last(c) for c in attributes])
    cited = cited.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    used = relations["authorships"]
    out = {
        "works": works,
        **relations,
        "references": cited,
        "authors": best_rows(merged["authors"].join(used.select("author_id").distinct(), "author_id", "left_semi"), "author_id"),
        "institutions": best_rows(merged["institutions"].join(used.select("institution_id").filter("institution_id IS NOT NULL").distinct(), "institution_id", "left_semi"), "institution_id"),
        "sources": best_rows(merged["sources"].join(works.select("source_id").filter("source_id IS NOT NULL").distinct(), "source_id", "left_semi"), "source_id"),
        "duplicates": merged["duplicates"].unionByName(ranked.filter("_rank > 1").select(F.col("_kept").alias("kept_work_id"), F.col("work_id").alias("removed_work_id"), F.when(F.col("_dedup_key").startswith("doi:"), "doi").when(F.col("_dedup_key").startswith("dedup:"), "title_year").otherwise("record").alias("rule"))),
    }
    rule = F.when(F.col("year").isNull(), "missing_year").when(F.col("year") < year_from, "before_scope").otherwise("after_scope")
    outside = winners.filter(F.col("year").isNull() | ~F.col("year").between(year_from, year_to)).select("work_id", "year", rule.alias("rule"))
    ledger = remapped(merged["provenance"], "work_id").join(outside, "work_id").select("work_id", "source", "source_record_id", "source_record_hash", F.col("year").alias("publication_year"), "rule", F.concat(F.lit("year="), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(f"; scope={year_from}-{year_to}")).alias("detail"))
    return {t: shaped(out[t], t) for t in TABLES} | {"excluded_records": ledger}


def quality_gate(tables: dict[str, DataFrame], processed: int, year_from: int, year_to: int) -> DataFrame:
    """(check, value, passed): keys, orphans, year bounds, placeholder ids and conservation of input records."""
    spark = tables["works"].sparkSession
    checks: list[tuple[str, DataFrame]] = []
    for t, keys in (("works", ["work_id"]), ("authors", ["author_id"]), ("institutions", ["institution_id"]), ("sources", ["source_id"]), ("references", ["citing_work_id", "cited_work_id"])):
        checks.append((f"unique.{t}", tables[t].agg((F.count(F.lit(1)) - F.countDistinct(F.struct(*keys))).alias("v"))))
    for t, c, u, d in (("authorships", "work_id", "works", "work_id"), ("authorships", "author_id", "authors", "author_id"), ("keywords", "work_id", "works", "work_id"), ("topics", "work_id", "works", "work_id"), ("references", "citing_work_id", "works", "work_id"), ("provenance", "work_id", "works", "work_id"), ("authorships", "institution_id", "institutions", "institution_id"), ("works", "source_id", "sources", "source_id")):
        checks.append((f"orphans.{t}.{c}", tables[t].select(F.col(c).alias("k")).filter("k IS NOT NULL").join(tables[u].select(F.col(d).alias("k")), "k", "left_anti").agg(F.count(F.lit(1)).alias("v"))))
    checks.append(("year_bounds", tables["works"].agg(F.count_if(~F.coalesce(F.col("year").between(year_from, year_to), F.lit(False))).alias("v"))))
    checks.append(("placeholder_authors", tables["authors"].agg(F.count_if(T.is_placeholder(F.col("author_id"))).alias("v"))))
    counted = tables["provenance"].agg(F.count(F.lit(1)).alias("a")).crossJoin(tables["excluded_records"].agg(F.count(F.lit(1)).alias("b")))
    checks.append(("conservation", counted.select((F.col("a") + F.col("b") - processed).alias("v"))))
    out = spark.createDataFrame([], "check string, value long")
    for name, df in checks:
        out = out.unionByName(df.select(F.lit(name).alias("check"), F.col("v").cast("long").alias("value")))
    return out.withColumn("passed", F.col("value") == 0)


def repair_authors(authorships: DataFrame) -> DataFrame:
    """Placeholder author ids become per-(work, position) occurrences."""
    occurrence = T.stable_id("openalex-author-occurrence", F.col("work_id"), F.col("position"))
    return authorships.withColumn("author_id", F.when(T.is_placeholder(F.col("author_id")), occurrence).otherwise(F.col("author_id")))


def scope_audit(memberships: DataFrame, selected: DataFrame, group: str, item: str) -> DataFrame:
    """Share of memberships, items and pair mass that a selection of items retains."""
    base = memberships.select(group, item).distinct()
    chosen = selected.select(item).distinct()

    def mass(df: DataFrame, s: str) -> DataFrame:
        sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias(f"mass{s}"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"rows{s}")).crossJoin(df.agg(F.countDistinct(item).alias(f"items{s}")))

    both = mass(base, "").crossJoin(mass(base.join(chosen, item, "left_semi"), "_kept"))
    return both.select("rows", "mass", "items", F.try_divide("rows_kept", "rows").alias("membership_share"), F.try_divide("mass_kept", "mass").alias("mass_share"), F.try_divide("items_kept", "items").alias("item_share"))


def synthetic_records(spark: SparkSession, n: int) -> DataFrame:
    """Generated Crossref-shaped records: two authors and ten references each."""
    i = F.col("id")
    author = F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.struct(F.lit("Given").alias("given"), F.concat(F.lit("Family"), ((i + k) % F.lit(max(1, n // 5))).cast("string")).alias("family"), F.lit(None).cast("string").alias("ORCID"), F.array(F.struct(F.concat(F.lit("University "), (i % 50).cast("string")).alias("name"))).alias("affiliation")))
    reference = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct(F.concat(F.lit("10.5555/ref."), (i * 10 + k).cast("string")).alias("DOI"), F.lit(None).cast("string").alias("article-title"), F.lit(None).cast("string").alias("author"), F.lit("2019").alias("year"), F.lit(None).cast("string").alias("unstructured")))
    date = F.struct(F.array(F.array((F.lit(2020) + i % 6).cast("int"))).alias("date-parts"))
    made = {
        "DOI": F.concat(F.lit("10.5555/work."), i.cast("string")), "URL": F.concat(F.lit("https://doi.org/10.5555/work."), i.cast("string")), "title": F.array(F.concat(F.lit("Synthetic bibliometric record number "), i.cast("string"))),
        "published": date, "type": F.lit("journal-article"), "container-title": F.array(F.concat(F.lit("Journal "), (i % 20).cast("string"))), "author": author, "subject": F.array(F.concat(F.lit("Topic "), (i % 30).cast("string"))), "reference": reference,
        "references-count": F.lit(10).cast("long"), "is-referenced-by-count": (i % 100).cast("long"), "publisher": F.lit("Press"),
    }
    from pyspark.sql.types import StructType

    from scholium.schema import CROSSREF

    shape = StructType.fromDDL(CROSSREF)
    return spark.range(n).select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])
