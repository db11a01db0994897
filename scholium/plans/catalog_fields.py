"""Queries over field normalizers, joins by parameter lists and audits, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import audits as U
from scholium.plans.catalog import query

_DOI = r"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'https://doi.org/10.1234/ABC.' || p_partkey || '.' WHEN 1 THEN ' doi: 10.5555/x' || p_partkey
WHEN 2 THEN 'not a doi ' || p_partkey WHEN 3 THEN 'HTTP://DX.DOI.ORG/10.1000/' || p_partkey || ' ;,' ELSE NULL END AS raw FROM part"""


def _raw(c, sql: str, table: str):
    """The rows of a plain SELECT over one table, in Spark."""
    return c.spark.sql(sql.replace(f"FROM {table}", "FROM {t}"), t=c.table(table))


query("f02_doi", rf"""SELECT p_partkey, CASE WHEN regexp_matches(x, '^10\.\d{{4,9}}/\S+$') THEN x END AS doi FROM (SELECT p_partkey,
regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '^https?://(dx\.)?doi\.org/', ''), '^doi:\s*', ''), '[ .;,]+$', '') AS x FROM ({_DOI}))""")(
    lambda c: _raw(c, _DOI, "part").select("p_partkey", T.normalize_doi(F.col("raw")).alias("doi"))
)

_ORCID = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://orcid.org/0000-0002-1825-' || lpad(CAST(c_custkey AS STRING), 4, '0')
WHEN 1 THEN '0000-0001-5109-370X ' ELSE '0000-12' || c_custkey END AS raw FROM customer"""
query("f03_orcid", rf"""SELECT c_custkey, CASE WHEN regexp_matches(x, '^\d{{4}}-\d{{4}}-\d{{4}}-[\dX]{{4}}$') THEN x END AS orcid FROM
(SELECT c_custkey, replace(trim(raw), 'https://orcid.org/', '') AS x FROM ({_ORCID}))""")(lambda c: _raw(c, _ORCID, "customer").select("c_custkey", T.normalize_orcid(F.col("raw")).alias("orcid")))

_DATES = "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders"


def _dates(c):
    rows = _raw(c, _DATES, "orders")
    none = F.array().cast("array<array<int>>")
    whole = F.array(F.array("y", "m", "d"))
    published = F.when(F.col("o_orderkey") % 3 == 0, whole).when(F.col("o_orderkey") % 3 == 1, none)
    year, date = T.date_parts(published, F.when(F.col("o_orderkey") % 2 == 0, F.array(F.array("y"))), F.when(F.col("o_orderkey") % 5 == 0, F.array(F.array("y", "m"))))
    return rows.select("o_orderkey", year.alias("year"), date.alias("date"))


query("f10_date_precedence", f"""SELECT o_orderkey, CASE WHEN p IS NOT NULL THEN y::BIGINT END AS year, CASE p WHEN 3 THEN strftime(make_date(y::INT, m::INT, d::INT), '%Y-%m-%d') WHEN 1 THEN y::VARCHAR WHEN 2 THEN y || '-' || lpad(m::VARCHAR, 2, '0') END AS date
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 3 WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 END AS p FROM ({_DATES}))""")(_dates)


def _inverted(c):
    words = F.split("p_name", " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))))
    return c.table("part").select("p_partkey", T.inverted_abstract(index).alias("abstract"))


query("f11_inverted_abstract", "SELECT p_partkey, p_name AS abstract FROM part")(_inverted)
query("f12_year_in_text", r"""SELECT o_orderkey, nullif(regexp_extract(t, '\b((?:18|19|20|21)\d{2})\b', 1), '')::BIGINT AS year FROM (SELECT o_orderkey, 'no. 12' || o_orderkey || ' of ' || CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE '' END || year(o_orderdate) || ', 2150' AS t FROM orders)""")(
    lambda c: c.table("orders").select("o_orderkey", T.year_of(F.concat(F.lit("no. 12"), F.col("o_orderkey").cast("string"), F.lit(" of "), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(""), F.year("o_orderdate").cast("string"), F.lit(", 2150"))).alias("year"))
)
query("f12_split_list", r"""SELECT p_partkey, len(x) AS parts, array_to_string(x, '+') AS joined FROM (SELECT p_partkey, list_filter(list_transform(string_split_regex(replace(p_type, ' ', ' ; ') || '|' || p_brand || ';;', ';|\|'), lambda v: trim(v)), lambda v: v <> '') AS x FROM part)""")(
    lambda c: c.table("part").select("p_partkey", T.split_list(F.concat(F.replace("p_type", F.lit(" "), F.lit(" ; ")), F.lit("|"), "p_brand", F.lit(";;"))).alias("x")).select("p_partkey", F.size("x").cast("long").alias("parts"), F.array_join("x", "+").alias("joined"))
)
query("f14_completeness", "SELECT doc_id, (text IS NOT NULL)::INT + (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (quality IS NOT NULL)::INT AS held FROM documents LEFT JOIN labels USING (doc_id)")(
    lambda c: c.documents.join(c.table("labels"), "doc_id", "left").select("doc_id", T.completeness(["text", "lang", "source", "quality"]).alias("held"))
)
query("f17_citation_label", """SELECT c_custkey, coalesce(CASE WHEN a <> '' THEN CASE WHEN y IS NOT NULL THEN a || ' (' || y || ')' ELSE a END END, nullif(trim(d), ''), nullif(trim(t), ''), c_custkey::VARCHAR) AS label FROM
(SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS a, CASE WHEN c_custkey % 2 = 0 THEN 1990 + c_custkey % 30 END AS y, CASE WHEN c_custkey % 6 = 0 THEN '10.1/' || c_custkey ELSE ' ' END AS d, CASE WHEN c_custkey % 9 = 0 THEN c_mktsegment END AS t FROM customer)""")(
    lambda c: c.table("customer").select("c_custkey", T.citation_label(
        F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, 1990 + F.col("c_custkey") % 30),
        F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("10.1/"), F.col("c_custkey").cast("string"))).otherwise(" "), F.when(F.col("c_custkey") % 9 == 0, F.col("c_mktsegment")), F.col("c_custkey")).alias("label"))
)
_REFERENCE = "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name WHEN s_suppkey % 4 = 1 THEN ' ' END AS title, CASE s_suppkey % 5 WHEN 0 THEN 'Author Unknown' WHEN 1 THEN 'unknown ' WHEN 2 THEN NULL ELSE 'A. ' || s_name END AS author, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1999 END AS year FROM supplier"
query("f18_reference_label", f"""SELECT s_suppkey, coalesce(nullif(trim(title), ''), nullif(concat_ws(' ', CASE WHEN lower(trim(author)) NOT IN ('', 'author unknown', 'unknown', '0') THEN trim(author) END, CASE WHEN year <> 0 THEN year::VARCHAR END), ''), 'Unresolved reference') AS label FROM ({_REFERENCE})""")(
    lambda c: _raw(c, _REFERENCE, "supplier").select("s_suppkey", T.reference_label(F.col("title"), F.col("author"), F.col("year")).alias("label"))
)
_ALIAS = " ".join(f"WHEN norm = '{k}' THEN '{v}'" for k, v in T.KEYWORD_ALIASES.items())
_GENERIC = ", ".join(f"'{t}'" for t in T.GENERIC_TERMS)
_WORDS = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Large_Language  Models.' WHEN 1 THEN 'Young Adult' WHEN 2 THEN 'DNA' WHEN 3 THEN ' <b>deep</b>_LEARNING;' ELSE lower(p_type) END AS raw FROM part"
query("f09_keywords", rf"""SELECT p_partkey, CASE WHEN t IS NULL OR norm IN ({_GENERIC}) THEN NULL ELSE CASE {_ALIAS} WHEN length(t) <= 5 AND t = upper(t) AND t <> lower(t) THEN t ELSE upper(norm[1]) || norm[2:] END END AS keyword
FROM (SELECT *, regexp_replace(trim(regexp_replace(replace(lower(t), '_', ' '), '\s+', ' ', 'g')), '^[ .;,]+|[ .;,]+$', '', 'g') AS norm FROM (SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS t FROM ({_WORDS})))""")(
    lambda c: _raw(c, _WORDS, "part").select("p_partkey", T.normalize_keyword(F.col("raw"), T.clean_ascii).alias("keyword"))
)
query("s30_canonical_hash", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation""")(
    lambda c: c.table("nation").select("n_nationkey", T.canonical_hash("n_regionkey", "n_name", "n_nationkey").alias("digest"))
)
_IDS = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'https://x.org/None' WHEN 2 THEN ' ' WHEN 3 THEN 'NaN' WHEN 4 THEN 'a:null/' ELSE 'https://x.org/A' || event_id END AS raw FROM events"
query("f26_placeholder_ids", rf"SELECT event_id, raw IS NULL OR regexp_matches(lower(trim(raw)), '(^|[:/])\s*(none|null|nan|)/?$') AS placeholder FROM ({_IDS})")(lambda c: _raw(c, _IDS, "events").select("event_id", T.is_placeholder(F.col("raw")).alias("placeholder")))

# ---- audits ----

query("p05_resolved_references", "SELECT l_orderkey, l_linenumber, ref FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN 'reference:' || l_partkey WHEN l_partkey % 11 <> 0 THEN 'work:' || l_partkey END AS ref FROM lineitem) WHERE ref NOT LIKE 'reference:%'")(
    lambda c: U.resolved(c.table("lineitem").select("l_orderkey", "l_linenumber", F.expr("CASE WHEN l_partkey % 7 = 0 THEN 'reference:' || l_partkey WHEN l_partkey % 11 <> 0 THEN 'work:' || l_partkey END").alias("ref")), "ref")
)
query("j15_parameter_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 7, 32, 100000000, 39)")(
    lambda c: U.listed(c.table("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", [1, 2, 3, 7, 7, 32, 100000000, 39, None])
)
query("s02_row_order")(lambda c: U.in_file_order(c.table("documents")).select("doc_id", "row_index"))
query("a32_family_rates", """SELECT o_orderpriority AS family, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS rate,
row_number() OVER (ORDER BY round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 12), o_orderpriority) = 1 AS weakest FROM orders GROUP BY 1""")(
    lambda c: U.family_rates(c.table("orders"), "o_orderpriority", F.col("o_orderstatus") == "F").withColumnRenamed("o_orderpriority", "family")
)
query("y06_paired_conditions", "SELECT a.c_custkey, a.v AS first, b.v AS second, b.v - a.v AS gain FROM (SELECT c_custkey, c_acctbal AS v FROM customer) a JOIN (SELECT c_custkey, c_acctbal * 2 AS v FROM customer) b USING (c_custkey)")(
    lambda c: U.paired(c.table("customer").select("c_custkey", F.col("c_acctbal").alias("first")), c.table("customer").select("c_custkey", (F.col("c_acctbal") * 2).alias("second")), ["c_custkey"]).withColumn("gain", F.col("second") - F.col("first"))
)
query("g25_network_facts", """, e AS (SELECT a.l_partkey AS source, b.l_partkey AS target, count(DISTINCT a.l_orderkey) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL),
d AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT node FROM d ORDER BY degree DESC, node LIMIT 1) AS hub, (SELECT max(degree) FROM d) AS hub_degree,
(SELECT source FROM e ORDER BY weight DESC, source, target LIMIT 1) AS strongest_source, (SELECT target FROM e ORDER BY weight DESC, source, target LIMIT 1) AS strongest_target, (SELECT max(weight) FROM e) AS strongest_weight""")(
    lambda c: U.network_facts(_supplied_pairs(c))
)
query("d26_count_benchmark", """SELECT term, count(DISTINCT doc) AS documents FROM (SELECT i // 4 AS doc, (i // 4 * 7 + i % 4 * 13) % 1000 AS term FROM range(0, 400000) t(i)) GROUP BY term ORDER BY documents DESC, term LIMIT 800""")(
    lambda c: U.count_benchmark(c.spark, 100_000, 4, 1000, 800)
)
query("y08_exact_reuse", "SELECT count(*) FILTER (WHERE b.h IS NOT NULL) AS reused, count(*) FILTER (WHERE b.h IS NULL) AS to_encode FROM (SELECT sha256(coalesce(text, '')) AS h FROM documents) a LEFT JOIN (SELECT DISTINCT sha256(coalesce(text, '')) AS h FROM documents WHERE lang = 'en') b USING (h)")(
    lambda c: U.exact_reuse(c.documents, c.documents.filter("lang = 'en'"), "text").groupBy().agg(F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("to_encode"))
)


def _supplied_pairs(c):
    from scholium.operators import networks as N

    rows = c.table("lineitem").select("l_orderkey", "l_partkey")
    return N.group_pairs(rows, "l_orderkey", "l_partkey")
