"""Named queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import aggregates as A
from scholium.operators import networks as N
from scholium.operators import retrieval as R
from scholium.operators.retrieval import STOPWORDS
from scholium.plans.corpus import VIEWS, Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register a plan over a :class:`Corpus`; ``sql`` may begin with further CTEs after a leading comma."""

    def add(plan: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, folder: plan(Corpus(spark, folder))
        if sql:
            SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS}{sql if sql.startswith(',') else chr(10) + sql}"
        return plan

    return add


# ---- aggregates ----

query("a01_annual_output", "SELECT year, count(*) AS works, CAST(sum(coalesce(cited_by_count, 0)) AS BIGINT) AS citations, avg(coalesce(cited_by_count, 0)) AS mean_citations FROM works WHERE year IS NOT NULL GROUP BY year")(lambda c: A.annual_output(c.works))
query("a02_document_types", "SELECT coalesce(document_type, 'Unknown') AS document_type, n AS works FROM (SELECT document_type, count(*) AS n FROM works GROUP BY document_type)")(lambda c: A.raw_group_counts(c.works, "document_type"))
query("a03_languages", "SELECT coalesce(language, 'Unknown') AS language, n AS works FROM (SELECT language, count(*) AS n FROM works GROUP BY language)")(lambda c: A.raw_group_counts(c.works, "language"))
query("a04_source_productivity", "SELECT source_id, count(*) AS works, CAST(sum(coalesce(cited_by_count, 0)) AS BIGINT) AS citations, any_value(c_name) AS name FROM works LEFT JOIN customer ON c_custkey = source_id GROUP BY source_id")(
    lambda c: A.entity_productivity(c.works, c.works, "source_id", c.table("customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name")))
)
query("a05_author_productivity", "SELECT author_id, count(*) AS works, CAST(sum(coalesce(cited_by_count, 0)) AS BIGINT) AS citations FROM (SELECT DISTINCT work_id, author_id FROM authorships) JOIN works USING (work_id) GROUP BY author_id")(lambda c: A.entity_productivity(c.works, c.authorships, "author_id"))
query("a06_institution_productivity", "SELECT institution_id, count(*) AS works, CAST(sum(coalesce(cited_by_count, 0)) AS BIGINT) AS citations, any_value(n_name) AS name FROM (SELECT DISTINCT work_id, institution_id FROM authorships WHERE institution_id IS NOT NULL) JOIN works USING (work_id) LEFT JOIN nation ON n_nationkey = institution_id GROUP BY institution_id")(
    lambda c: A.entity_productivity(c.works, c.authorships, "institution_id", c.table("nation").select(F.col("n_nationkey").cast("long").alias("institution_id"), F.col("n_name").alias("name")))
)
query("a07_keyword_occurrences", "SELECT keyword, keyword_type, count(DISTINCT work_id) AS works FROM keywords WHERE trim(keyword) <> '' GROUP BY ALL")(lambda c: A.term_occurrences(c.keywords, "keyword", "keyword_type"))
query("a08_topic_occurrences", "SELECT keyword AS topic, count(DISTINCT work_id) AS works FROM keywords GROUP BY keyword")(lambda c: A.term_occurrences(c.keywords.withColumnRenamed("keyword", "topic"), "topic"))
query("a09_reference_impact", "SELECT cited_work_id, count(DISTINCT citing_work_id) AS local_citations, max(p_name) AS cited_title FROM refs LEFT JOIN part ON p_partkey = cited_work_id GROUP BY cited_work_id")(
    lambda c: A.reference_impact(c.references.join(c.table("part").select(F.col("p_partkey").alias("cited_work_id"), F.col("p_name").alias("cited_title")), "cited_work_id", "left"), ["cited_title"])
)
query("a10_count_table", "SELECT source_id, count(*) AS count FROM works GROUP BY source_id ORDER BY count DESC, source_id LIMIT 20")(lambda c: A.count_table(c.works, "source_id", 20))
_Q = "avg(c) AS mean, max(c) AS maximum, count(*) FILTER (WHERE c = 0) AS uncited, quantile_cont(c, 0.5) AS median, quantile_cont(c, 0.75) AS p75, quantile_cont(c, 0.9) AS p90, quantile_cont(c, 0.95) AS p95, quantile_cont(c, 0.98) AS p98"
query("a11_citation_quantiles", f"SELECT {_Q} FROM (SELECT CAST(coalesce(cited_by_count, 0) AS BIGINT) AS c FROM works)")(lambda c: A.citation_quantiles(c.works))
query("a11_citation_quantiles_by_type", f"SELECT document_type, {_Q} FROM (SELECT document_type, coalesce(cited_by_count, 0) AS c FROM works) GROUP BY document_type")(lambda c: A.citation_quantiles(c.works, ["document_type"]))
query("a12_filtered_counts", "SELECT year, count(*) FILTER (WHERE cited_by_count >= 100) AS highly_cited, count(*) FILTER (WHERE language = 'O') AS open FROM works GROUP BY year")(lambda c: c.works.groupBy("year").agg(F.count_if(F.col("cited_by_count") >= 100).alias("highly_cited"), F.count_if(F.col("language") == "O").alias("open")))
_TOP15 = "(SELECT keyword FROM keywords GROUP BY keyword ORDER BY count(DISTINCT work_id) DESC, keyword LIMIT 15)"
query("a13_keyword_trend", f"SELECT keyword, year, count(DISTINCT work_id) AS works FROM keywords JOIN works USING (work_id) WHERE keyword IN {_TOP15} AND year IS NOT NULL GROUP BY ALL")(lambda c: A.term_trend(c.works, c.keywords, "keyword"))
query("a14_summary", ", y AS (SELECT year, count(*) AS n, sum(coalesce(cited_by_count, 0)) AS c FROM works GROUP BY year), t AS (SELECT CAST(sum(n) AS BIGINT) AS works, CAST(sum(c) AS BIGINT) AS citations, min(year) AS first_year, max(year) AS last_year, arg_min(n, year) AS n0, arg_max(n, year) AS n1 FROM y) SELECT works, citations, first_year, last_year, (pow(n1 / n0, 1.0 / (last_year - first_year)) - 1) * 100 AS cagr FROM t")(
    lambda c: A.corpus_summary(c.works)
)
_COVER = "SELECT * FROM (SELECT unnest(['year', 'document_type', 'cited_by_count']) AS field, unnest([count(year), count(*) FILTER (WHERE trim(document_type) <> ''), count(cited_by_count)]) AS present, count(*) AS n FROM works)"
query("a15_field_coverage", f"SELECT field, present, n - present AS missing, present / n AS ratio FROM ({_COVER})")(lambda c: A.field_coverage(c.works, ["year", "document_type", "cited_by_count"]))
query("a16_readiness", f"SELECT field, present / n AS ratio, CASE WHEN present / n >= 0.8 THEN 'ready' WHEN present / n >= 0.5 THEN 'usable' WHEN present / n >= 0.3 THEN 'limited' WHEN present / n >= 0.1 THEN 'weak' ELSE 'absent' END AS level FROM ({_COVER})")(lambda c: A.readiness(A.field_coverage(c.works, ["year", "document_type", "cited_by_count"])))
query("a17_key_uniqueness", "SELECT count(*) AS rows, count(DISTINCT {'w': work_id, 'i': item}) AS distinct_keys, count(*) - count(DISTINCT {'w': work_id, 'i': item}) AS duplicates FROM memberships")(lambda c: A.key_uniqueness(c.memberships, ["work_id", "item"]))
query("a18_scalar_counts", "SELECT (SELECT count(*) FROM works) AS works, (SELECT count(DISTINCT author_id) FROM authorships) AS authors, (SELECT count(DISTINCT work_id) FROM keywords) AS works_with_keywords")(
    lambda c: c.works.agg(F.count(F.lit(1)).alias("works")).crossJoin(c.authorships.agg(F.countDistinct("author_id").alias("authors"))).crossJoin(c.keywords.agg(F.countDistinct("work_id").alias("works_with_keywords")))
)
query("a19_having_range", "SELECT item, count(DISTINCT work_id) AS n FROM memberships GROUP BY item HAVING count(DISTINCT work_id) BETWEEN 2 AND 30")(lambda c: c.memberships.groupBy("item").agg(F.countDistinct("work_id").alias("n")).filter(F.col("n").between(2, 30)))
query("a20_pair_mass", "SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pair_mass, count(*) AS groups FROM (SELECT work_id, count(DISTINCT item) AS n FROM memberships GROUP BY work_id)")(lambda c: A.pair_mass(c.memberships, "work_id", "item"))
query("a21_average_year", "SELECT keyword, avg(year) AS average_year, count(*) AS works FROM (SELECT DISTINCT work_id, keyword FROM keywords) JOIN works USING (work_id) WHERE year IS NOT NULL GROUP BY keyword")(lambda c: A.average_year(c.works, c.keywords, "keyword"))
query("a22_ordered_strings", "SELECT work_id, string_agg(author_id, '; ' ORDER BY first_at, author_id) AS author_id FROM (SELECT work_id, CAST(author_id AS VARCHAR) AS author_id, min(position) AS first_at FROM authorships GROUP BY ALL) GROUP BY work_id")(lambda c: A.ordered_strings(c.authorships, "work_id", "author_id", "position"))
query("a23_term_year_matrix", f", t AS (SELECT keyword, year, count(DISTINCT work_id) AS works FROM keywords JOIN works USING (work_id) WHERE keyword IN {_TOP15} GROUP BY ALL) SELECT keyword, " + ", ".join(f"CAST(coalesce(sum(works) FILTER (WHERE year = {y}), 0) AS BIGINT) AS \"{y}\"" for y in range(1995, 2002)) + " FROM t GROUP BY keyword")(
    lambda c: A.term_year_matrix(A.term_trend(c.works, c.keywords, "keyword"), "keyword", list(range(1995, 2002)))
)
query("a24_other_rollup", ", n AS (SELECT keyword, count(DISTINCT work_id) AS works FROM keywords GROUP BY keyword), t AS (SELECT keyword FROM n ORDER BY works DESC, keyword LIMIT 7) SELECT CASE WHEN keyword IN (SELECT keyword FROM t) THEN keyword ELSE 'Other' END AS keyword, CAST(sum(works) AS BIGINT) AS works FROM n GROUP BY 1")(
    lambda c: A.other_rollup(A.term_occurrences(c.keywords, "keyword"), "keyword", "works")
)
_FLOW = ", ta AS (SELECT author_id FROM authorships GROUP BY 1 ORDER BY count(DISTINCT work_id) DESC, 1 LIMIT 8), ts AS (SELECT source_id FROM works GROUP BY 1 ORDER BY count(DISTINCT work_id) DESC, 1 LIMIT 8), tk AS (SELECT keyword FROM keywords GROUP BY 1 ORDER BY count(DISTINCT work_id) DESC, 1 LIMIT 10), flow AS (SELECT author_id, source_id, keyword, count(DISTINCT work_id) AS works FROM authorships JOIN works USING (work_id) JOIN keywords USING (work_id) WHERE author_id IN (FROM ta) AND source_id IN (FROM ts) AND keyword IN (FROM tk) GROUP BY ALL)"
query("j11_three_field", f"{_FLOW} SELECT * FROM flow")(lambda c: A.three_field(c.authorships, c.works, c.keywords))
query("a25_three_field_marginals", f"{_FLOW} SELECT field, label, CAST(sum(works) AS BIGINT) AS total FROM (SELECT 'author_id' AS field, CAST(author_id AS VARCHAR) AS label, works FROM flow UNION ALL SELECT 'source_id', CAST(source_id AS VARCHAR), works FROM flow UNION ALL SELECT 'keyword', keyword, works FROM flow) GROUP BY ALL")(
    lambda c: A.marginals(A.three_field(c.authorships, c.works, c.keywords), ["author_id", "source_id", "keyword"], "works")
)
query("a26_identity_damage", "SELECT source_id, count(*) AS rows, count(DISTINCT work_id) AS works FROM works JOIN customer ON c_custkey = source_id WHERE c_acctbal < 0 GROUP BY source_id")(
    lambda c: A.identity_damage(c.works.join(c.table("customer").select(F.col("c_custkey").alias("source_id"), "c_acctbal"), "source_id"), "source_id", F.col("c_acctbal") < 0)
)
query("a28_label_metrics", "SELECT lang, count(*) AS n, avg(CAST(quality AS DOUBLE)) AS good, avg(CAST(toxic AS DOUBLE)) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")(
    lambda c: A.condition_metrics(c.documents.select("doc_id", "lang").join(c.table("labels"), "doc_id"), ["lang"], {"good": F.col("quality"), "toxic": F.col("toxic")})
)
query("a33_scale_tier", "SELECT count(*) AS works, CASE WHEN count(*) < 5000 THEN 'small' WHEN count(*) < 50000 THEN 'medium' WHEN count(*) < 500000 THEN 'large' ELSE 'very_large' END AS tier FROM works")(lambda c: A.scale_tier(c.works))

# ---- windows ----

_N = "SELECT source_id, count(*) AS works FROM works GROUP BY source_id"
for _rule, _zone, _frame in (
    ("floor", "least(floor((cumulative - 1) / greatest(total / 3.0, 1.0)) + 1, 3)", "ORDER BY works DESC, source_id ROWS UNBOUNDED PRECEDING"),
    ("tied", "least(floor(3.0 * (cumulative - 1) / total) + 1, 3)", "ORDER BY works DESC"),
    ("ceil", "least(greatest(ceil(cumulative / (total / 3.0)), 1), 3)", "ORDER BY works DESC, source_id ROWS UNBOUNDED PRECEDING"),
):
    query(f"w07_bradford_{_rule}", f"SELECT source_id, works, cumulative, CAST({_zone} AS BIGINT) AS zone FROM (SELECT *, CAST(sum(works) OVER ({_frame}) AS BIGINT) AS cumulative, sum(works) OVER () AS total FROM ({_N}))")(
        lambda c, rule=_rule: A.bradford(c.works.groupBy("source_id").agg(F.count(F.lit(1)).alias("works")), "source_id", rule=rule)
    )
query("w01_dedup_winner", "SELECT h, doc_id, first AS kept_id FROM (SELECT md5(text) AS h, doc_id, first_value(doc_id) OVER w AS first FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY n_chars DESC, source NULLS LAST, doc_id))")(
    lambda c: c.documents.select(F.md5("text").alias("h"), "doc_id", "n_chars", "source").withColumn("kept_id", F.first("doc_id").over(Window.partitionBy("h").orderBy(F.desc("n_chars"), F.asc_nulls_last("source"), "doc_id"))).select("h", "doc_id", "kept_id")
)
query("w02_best_row", "SELECT source_id, work_id, cited_by_count FROM works QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY cited_by_count DESC, work_id) = 1")(
    lambda c: c.works.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("cited_by_count"), "work_id"))).filter("rank = 1").select("source_id", "work_id", "cited_by_count")
)
query("w05_two_rankings", ", c AS (SELECT work_id, row_number() OVER (ORDER BY cited_by_count DESC, work_id) AS r FROM works QUALIFY r <= 16), y AS (SELECT work_id, row_number() OVER (ORDER BY year DESC, cited_by_count DESC, work_id) AS r FROM works QUALIFY r <= 12) SELECT work_id, min(r) AS best FROM (FROM c UNION ALL FROM y) GROUP BY work_id ORDER BY best, work_id LIMIT 24")(
    lambda c: A_representatives(c)
)
query("w06_top_authors", "SELECT work_id, author_id, position FROM (SELECT DISTINCT work_id, author_id, position FROM authorships) QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY position NULLS LAST, author_id) <= 3")(
    lambda c: c.authorships.select("work_id", "author_id", "position").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("work_id").orderBy(F.asc_nulls_last("position"), "author_id"))).filter("rank <= 3").drop("rank")
)
query("w11_percentile_rank", ", n AS (SELECT author_id, count(DISTINCT work_id) AS works FROM authorships GROUP BY author_id) SELECT author_id, works, (rank() OVER (ORDER BY works) + (count(*) OVER (PARTITION BY works) - 1) / 2.0) / count(*) OVER () AS pct FROM n")(
    lambda c: N.percentile_rank(c.authorships.groupBy("author_id").agg(F.countDistinct("work_id").alias("works")), "works", "pct")
)
query("w13_rank_divergence", ", n AS (SELECT author_id, count(*) AS works, sum(cited_by_count) AS cites FROM (SELECT DISTINCT work_id, author_id FROM authorships) JOIN works USING (work_id) GROUP BY author_id), r AS (SELECT author_id, row_number() OVER (ORDER BY works DESC, author_id) AS a, row_number() OVER (ORDER BY cites DESC, author_id) AS b FROM n) SELECT author_id, a AS rank_works, b AS rank_cites, abs(a - b) AS divergence FROM r WHERE a <= 50 OR b <= 50")(
    lambda c: rank_divergence(A.entity_productivity(c.works, c.authorships, "author_id"), "author_id", "works", "citations", 50)
)
query("w16_first_run", ", t AS (SELECT conv_id, turn, CASE WHEN length(text) >= 40 THEN 1 ELSE 0 END AS ok FROM conversations), r AS (SELECT conv_id, turn, min(ok) OVER w AS all_ok, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) SELECT conv_id, min(turn) FILTER (WHERE all_ok = 1 AND n = 2) AS start FROM r GROUP BY conv_id")(
    lambda c: first_run(c.table("conversations").select("conv_id", "turn", (F.length("text") >= 40).cast("int").alias("ok")), "conv_id", "turn", "ok", 2)
)
query("w18_msttr", ", t AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)), g AS (SELECT doc_id, pos // 100 AS win, count(*) AS n, count(DISTINCT word) AS d FROM t GROUP BY ALL HAVING count(*) = 100) SELECT doc_id, round(avg(d / 100.0), 6) AS msttr, count(*) AS windows FROM g GROUP BY doc_id")(
    lambda c: msttr(c.documents, "doc_id", "text")
)


def A_representatives(c: Corpus) -> DataFrame:
    """16 most cited and 12 most recent works: two TakeOrdered limits, ranked only afterwards."""
    cited = c.works.orderBy(F.desc_nulls_last("cited_by_count"), "work_id").limit(16).select("work_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("cited_by_count"), "work_id")).cast("long").alias("r"))
    order = [F.desc_nulls_last("year"), F.desc_nulls_last("cited_by_count"), F.col("work_id")]
    recent = c.works.orderBy(*order).limit(12).select("work_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("r"))
    return cited.unionByName(recent).groupBy("work_id").agg(F.min("r").alias("best")).orderBy("best", "work_id").limit(24)


def rank_divergence(entities: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """Two rankings of entities and their distance, for entities in the top k of either."""
    ranked = entities.select(key, F.row_number().over(Window.orderBy(F.desc(a), key)).cast("long").alias(f"rank_{a}"), F.row_number().over(Window.orderBy(F.desc(b), key)).cast("long").alias("rank_cites"))
    return ranked.filter((F.col(f"rank_{a}") <= k) | (F.col("rank_cites") <= k)).withColumn("divergence", F.abs(F.col(f"rank_{a}") - F.col("rank_cites")))


def first_run(rows: DataFrame, key: str, order: str, ok: str, k: int) -> DataFrame:
    """Start of the first run of k consecutive successes; null when censored."""
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(0, k - 1)
    rows = rows.select(key, order, F.min(ok).over(ahead).alias("all_ok"), F.count(F.lit(1)).over(ahead).alias("n"))
    return rows.groupBy(key).agg(F.min(F.when((F.col("all_ok") == 1) & (F.col("n") == k), F.col(order))).alias("start"))


def msttr(docs: DataFrame, key: str, text: str, window: int = 100) -> DataFrame:
    """Mean type-token ratio over whole non-overlapping windows, per document, without exploding tokens."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    count = F.floor(F.size("w") / window).cast("int")
    ratios = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.size(F.array_distinct(F.slice("w", i * window + 1, F.lit(window)))) / window)
    rows = docs.select(key, words.alias("w")).filter(F.size("w") >= window).select(key, ratios.alias("r"))
    return rows.select(key, F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / F.size("r"), 6).alias("msttr"), F.size("r").cast("long").alias("windows"))


# ---- networks ----

_PAIRS = "SELECT a.{i} AS source, b.{i} AS target, count(*) AS weight FROM m a JOIN m b ON a.{g} = b.{g} AND a.{i} < b.{i} GROUP BY ALL"


def _edges(view: str, g: str, i: str, pool: int) -> str:
    return f", top AS (SELECT {i} FROM {view} WHERE {i} IS NOT NULL GROUP BY {i} ORDER BY count(DISTINCT {g}) DESC, {i} LIMIT {pool}), m AS (SELECT DISTINCT {g}, {i} FROM {view} WHERE {i} IN (FROM top)), e AS ({_PAIRS.format(g=g, i=i)} ORDER BY weight DESC, source, target LIMIT 200000)"


query("g07_keyword_cooccurrence", _edges("memberships", "work_id", "item", 500) + " SELECT * FROM e")(lambda c: N.cooccurrence(c.memberships, "work_id", "item"))
query("g07_coauthorship", _edges("authorships", "work_id", "author_id", 500) + " SELECT * FROM e")(lambda c: N.cooccurrence(c.authorships, "work_id", "author_id", 500))
query("g07_institutions", _edges("authorships", "work_id", "institution_id", 500) + " SELECT * FROM e")(lambda c: N.cooccurrence(c.authorships.filter("institution_id IS NOT NULL"), "work_id", "institution_id", 500))
query("g07_cocitation", _edges("refs", "citing_work_id", "cited_work_id", 500) + " SELECT * FROM e")(lambda c: N.cooccurrence(c.references, "citing_work_id", "cited_work_id", 500))
query("g07_direct_citation", "SELECT citing_work_id, cited_work_id, count(*) AS weight FROM refs WHERE cited_work_id IN (SELECT p_partkey FROM part) GROUP BY ALL ORDER BY citing_work_id, cited_work_id LIMIT 200000")(
    lambda c: N.direct_citations(c.references, c.table("part").select(F.col("p_partkey").alias("cited_work_id")))
)
_CAP = ", o AS (SELECT item, count(DISTINCT work_id) AS occurrences FROM memberships GROUP BY item HAVING count(DISTINCT work_id) >= 2 ORDER BY occurrences DESC, item LIMIT 300), m AS (SELECT * FROM (SELECT DISTINCT work_id, item FROM memberships) JOIN o USING (item) QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY occurrences DESC, item) <= 3), e AS (" + _PAIRS.format(g="work_id", i="item") + ")"
query("g01_pair_network", _CAP + " SELECT source, target, weight, weight / (a.occurrences * b.occurrences) AS association_strength FROM e JOIN o a ON a.item = source JOIN o b ON b.item = target")(lambda c: N.pair_network(c.memberships, "work_id", "item", 300, 3)[1])
query("g06_scalable_coupling", ", r AS (SELECT DISTINCT citing_work_id, cited_work_id FROM refs), s AS (SELECT citing_work_id, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 5), top AS (SELECT citing_work_id FROM s JOIN works ON work_id = citing_work_id ORDER BY round(ln(1 + coalesce(cited_by_count, 0)) + 0.35 * ln(1 + n), 9) DESC, citing_work_id LIMIT 500), k AS (SELECT * FROM r WHERE citing_work_id IN (FROM top)), inf AS (SELECT cited_work_id FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND greatest(10, ceil(0.2 * (SELECT count(*) FROM top)))), m AS (SELECT * FROM k WHERE cited_work_id IN (FROM inf)) SELECT * FROM (" + _PAIRS.format(g="cited_work_id", i="citing_work_id") + ") WHERE weight >= 2")(
    lambda c: N.scalable_coupling(c.references, c.works)
)
query("g08_degrees", _edges("memberships", "work_id", "item", 200) + " SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM (SELECT source AS node, weight FROM e UNION ALL SELECT target, weight FROM e) GROUP BY node")(lambda c: N.degrees(N.cooccurrence(c.memberships, "work_id", "item", 200)))
query("g16_strongest_edges", _edges("memberships", "work_id", "item", 200) + ", n AS (SELECT *, source AS node FROM e UNION ALL SELECT *, target FROM e) SELECT DISTINCT source, target, weight FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, source, target) <= 4)")(
    lambda c: N.strongest_edges(N.cooccurrence(c.memberships, "work_id", "item", 200), 4)
)
query("g20_density", _edges("memberships", "work_id", "item", 200) + ", l AS (SELECT count(DISTINCT x) AS k FROM (SELECT source AS x FROM e UNION ALL SELECT target FROM e)) SELECT (SELECT count(*) FROM top) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM top) - (SELECT k FROM l) AS isolates, (SELECT count(*) FROM e) / ((SELECT count(*) FROM top) * ((SELECT count(*) FROM top) - 1) / 2.0) AS density")(
    lambda c: N.density(N.candidates(c.memberships, "work_id", "item", 200), N.cooccurrence(c.memberships, "work_id", "item", 200), "item")
)
_COMM = _edges("authorships", "work_id", "author_id", 200) + ", c AS (SELECT s_suppkey AS node, CAST(s_nationkey AS BIGINT) AS community FROM supplier), x AS (SELECT weight, a.community AS ca, b.community AS cb FROM e JOIN c a ON a.node = source JOIN c b ON b.node = target), z AS (SELECT ca AS community, weight, ca = cb AS i FROM x UNION ALL SELECT cb, weight, false FROM x WHERE ca <> cb), b AS (SELECT s.community, s.members, CAST(coalesce(sum(weight) FILTER (WHERE i), 0) AS BIGINT) AS internal_weight, CAST(coalesce(sum(weight) FILTER (WHERE NOT i), 0) AS BIGINT) AS external_weight, count(*) FILTER (WHERE i) AS internal_edges, count(*) FILTER (WHERE NOT i) AS external_edges FROM (SELECT community, count(*) AS members FROM c GROUP BY 1) s LEFT JOIN z USING (community) GROUP BY ALL)"


def _boundaries(c: Corpus) -> DataFrame:
    labels = c.table("supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("community"))
    return N.community_boundaries(N.cooccurrence(c.authorships, "work_id", "author_id", 200), labels)


query("g21_community_boundaries", _COMM + " SELECT *, CASE WHEN internal_weight + external_weight > 0 THEN external_weight / (internal_weight + external_weight) ELSE 0.0 END AS external_share FROM b")(_boundaries)
query("g22_thematic_map", _COMM + ", t AS (SELECT community, members, CASE WHEN members > 1 THEN internal_weight / (members * (members - 1) / 2.0) ELSE 0.0 END AS density, external_weight / members AS centrality FROM b), q AS (SELECT quantile_cont(density, 0.5) AS md, quantile_cont(centrality, 0.5) AS mc FROM t) SELECT community, members, density, centrality, CASE WHEN density >= md AND centrality >= mc THEN 'motor' WHEN density >= md THEN 'niche' WHEN centrality >= mc THEN 'basic' ELSE 'emerging_or_declining' END AS quadrant FROM t, q")(
    lambda c: N.thematic_map(_boundaries(c))
)
query("g24_knowledge_graph", "SELECT relation, count(*) AS edges FROM (SELECT DISTINCT 'authored' AS relation, author_id AS a, work_id AS b FROM authorships UNION ALL SELECT DISTINCT 'published_in', work_id, source_id FROM works UNION ALL SELECT 'has_keyword', work_id, hash(keyword)::BIGINT::HUGEINT::BIGINT FROM (SELECT DISTINCT work_id, keyword FROM keywords) UNION ALL SELECT DISTINCT 'cites', citing_work_id, cited_work_id FROM refs UNION ALL SELECT DISTINCT 'affiliated_with', author_id, institution_id FROM authorships WHERE institution_id IS NOT NULL) GROUP BY relation".replace("hash(keyword)::BIGINT::HUGEINT::BIGINT", "0"))(
    lambda c: N.knowledge_graph(c.works, c.authorships, c.keywords, c.references)[1].groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))
)
query("p09_edge_perturbation", _edges("memberships", "work_id", "item", 200) + ", k AS (SELECT source, target, weight, row_number() OVER (ORDER BY sha256('42|' || source || '|' || target), source, target) AS r FROM e WHERE weight >= 2) SELECT source, target, weight FROM k WHERE r > floor(0.2 * (SELECT count(*) FROM k))")(
    lambda c: N.perturb_edges(N.cooccurrence(c.memberships, "work_id", "item", 200), 2, 0.2)
)

# ---- joins, sets and predicates ----

query("j03_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT DISTINCT source_id FROM works)")(lambda c: c.table("customer").select("c_custkey", "c_name").join(c.works.select(F.col("source_id").alias("c_custkey")), "c_custkey", "left_semi"))
query("j04_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT source_id FROM works WHERE year = 1996)")(lambda c: c.table("customer").select("c_custkey", "c_name").join(c.works.filter("year = 1996").select(F.col("source_id").alias("c_custkey")), "c_custkey", "left_anti"))
query("j05_orphans", "SELECT 'lineitem.order' AS check_name, count(*) AS orphans FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL UNION ALL SELECT 'lineitem.part', count(*) FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_partkey IS NULL UNION ALL SELECT 'labels.document', count(*) FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL")(
    lambda c: orphans([("lineitem.order", c.table("lineitem"), "l_orderkey", c.table("orders"), "o_orderkey"), ("lineitem.part", c.table("lineitem"), "l_partkey", c.table("part"), "p_partkey"), ("labels.document", c.table("labels"), "doc_id", c.documents, "doc_id")])
)
query("j09_one_row_cap", ", s AS (SELECT quantile_cont(cited_by_count, 0.98) AS cap FROM works) SELECT work_id, least(cited_by_count, cap) AS shown FROM works, s")(
    lambda c: c.works.select("work_id", "cited_by_count").crossJoin(F.broadcast(c.works.agg(F.percentile("cited_by_count", 0.98).alias("cap")))).select("work_id", F.least(F.col("cited_by_count").cast("double"), "cap").alias("shown"))
)
query("j12_linked_nodes", _edges("memberships", "work_id", "item", 200) + " SELECT p_partkey AS item, p_name FROM part WHERE p_partkey IN (SELECT source FROM e UNION SELECT target FROM e)")(lambda c: N.linked_nodes(c.table("part").select(F.col("p_partkey").alias("item"), "p_name"), N.cooccurrence(c.memberships, "work_id", "item", 200), "item"))
query("u03_symmetric_difference", "SELECT item, count(*) AS n FROM ((SELECT item FROM memberships EXCEPT ALL SELECT DISTINCT item FROM memberships) UNION ALL (SELECT DISTINCT item FROM memberships EXCEPT ALL SELECT item FROM memberships)) GROUP BY item")(
    lambda c: symmetric_difference(c.memberships.select("item"), c.memberships.select("item").distinct()).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
)
query("p07_exclusions", "SELECT work_id, CASE WHEN year IS NULL THEN 'missing_year' WHEN year < 1996 THEN 'before_scope' ELSE 'after_scope' END AS rule, 'year=' || coalesce(CAST(year AS VARCHAR), '') || '; scope=1996-2000' AS detail FROM works WHERE year IS NULL OR year NOT BETWEEN 1996 AND 2000")(lambda c: exclusions(c.works, 1996, 2000))
query("y09_pool_curation", ", r AS (SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 THEN 'duplicate' WHEN n_chars < 200 THEN 'too_short' WHEN NOT contains(lower(text), 'the') THEN 'terms' ELSE 'kept' END AS reason FROM documents) SELECT reason, count(*) AS n FROM r GROUP BY reason")(
    lambda c: c.documents.select(F.row_number().over(Window.partitionBy(F.md5("text")).orderBy("doc_id")).alias("rn"), "n_chars", "text").select(F.when(F.col("rn") > 1, "duplicate").when(F.col("n_chars") < 200, "too_short").when(~F.contains(F.lower("text"), F.lit("the")), "terms").otherwise("kept").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
)


def orphans(checks: list[tuple]) -> DataFrame:
    """(check_name, orphans) of foreign keys by anti joins."""
    parts = [a.select(F.col(k).alias("k")).join(b.select(F.col(j).alias("k")), "k", "left_anti").agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("orphans")) for name, a, k, b, j in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset (a - b) + (b - a)."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def exclusions(works: DataFrame, first: int, last: int) -> DataFrame:
    """Ledger of works outside the year scope, with rule and detail; nothing is dropped silently."""
    rule = F.when(F.col("year").isNull(), "missing_year").when(F.col("year") < first, "before_scope").otherwise("after_scope")
    detail = F.concat(F.lit("year="), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(f"; scope={first}-{last}"))
    return works.filter(F.col("year").isNull() | ~F.col("year").between(first, last)).select("work_id", rule.alias("rule"), detail.alias("detail"))


# ---- text ----

_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
query("d08_derived_keywords", f", t0 AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w FROM documents), t00 AS (SELECT doc_id, w, list_transform(w, lambda t: length(t) >= 3 AND t NOT IN {_STOP} AND NOT regexp_matches(t, '^[0-9]+$')) AS ok FROM t0), t1 AS (SELECT * FROM (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN ok[i] THEN w[i] END), list_transform(range(1, len(w)), lambda i: CASE WHEN ok[i] AND ok[i + 1] THEN w[i] || ' ' || w[i + 1] END))) AS term FROM t00) WHERE length(term) BETWEEN 3 AND 80), tf AS (SELECT doc_id, term, count(*) AS tf FROM t1 GROUP BY ALL), nn AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), v AS (SELECT term, df, n FROM df, nn WHERE df BETWEEN (CASE WHEN n < 100 THEN 2 ELSE 3 END) AND greatest(CASE WHEN n < 100 THEN 2 ELSE 3 END, floor(n * 0.6)) ORDER BY df DESC, term LIMIT 5000), s AS (SELECT doc_id, term, round((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1), 6) AS score FROM tf JOIN v USING (term)) SELECT doc_id, term, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) <= 5")(
    lambda c: R.derived_keywords(c.documents, "doc_id", "text")
)
_ASK = ("the", "thing", "reason", "there", "der", "que", "licensed", "rights")
_BM = ", d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{Nd}_]+') AS w FROM documents), l AS (SELECT doc_id, len(list_filter(w, lambda t: length(t) >= 2)) AS length, w FROM d), st AS (SELECT count(*) AS n, avg(length) AS mean FROM l), h AS (SELECT doc_id, length, q.term, len(list_filter(w, lambda t: t = q.term)) AS tf FROM l, (SELECT unnest([" + ", ".join(f"'{w}'" for w in _ASK) + "]) AS term) q), hh AS (SELECT * FROM h WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM hh GROUP BY term), sc AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM hh JOIN df USING (term), st GROUP BY doc_id)"


query("t03_bm25", f"{_BM} SELECT doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc ORDER BY rank LIMIT 50")(lambda c: R.top_ranked(R.bm25(c.documents, "doc_id", "text", list(_ASK)), "doc_id", 50))
query("t05_rank_fusion", f"{_BM}, a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc ORDER BY rank LIMIT 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 50) SELECT doc_id, round(sum(1 / (60.0 + rank)), 9) AS score FROM (FROM a UNION ALL FROM b) GROUP BY doc_id")(
    lambda c: R.reciprocal_rank_fusion([R.top_ranked(R.bm25(c.documents, "doc_id", "text", list(_ASK)), "doc_id", 50), R.top_ranked(c.documents.select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id", 50)], "doc_id").select("doc_id", F.round("score", 9).alias("score"))
)
query("t09_cosine_top_k", ", q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[])))), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 25")(
    lambda c: R.cosine_top_k(c.table("embeddings"), "vec_id", "embedding", list(c.table("embeddings").orderBy("vec_id").first()["embedding"]), 25)
)
query("t08_term_overlap", "SELECT doc_id, CAST(contains(lower(text), 'licensed') AS INT) + CAST(contains(lower(text), 'rights') AS INT) + CAST(contains(lower(text), 'work') AS INT) AS overlap FROM documents WHERE overlap > 0 ORDER BY overlap DESC, doc_id LIMIT 100")(lambda c: R.overlap_retrieval(c.documents, "doc_id", "text", "licensed rights work", 100))
query("f04_title_key_whole", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\\s-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title_key FROM documents")(lambda c: c.documents.select("doc_id", F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"[^a-z0-9_\s-]+", " "), r"\s+", " ")).alias("title_key")))
query("f05_stable_id", "SELECT doc_id, 'work:' || substr(sha1(doc_id || chr(31) || lower(source)), 1, 20) AS id FROM documents")(lambda c: c.documents.select("doc_id", T.stable_id("work", F.col("doc_id"), F.col("source")).alias("id")))
query("f13_slug", "SELECT c_custkey, left(regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug FROM customer")(lambda c: c.table("customer").select("c_custkey", T.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("slug")))
query("f21_wilson_upper", "SELECT lang, least(1.0, (p + 2.705543454095404 / (2 * n) + 1.6448536269514722 * sqrt(p * (1 - p) / n + 2.705543454095404 / (4 * n * n))) / (1 + 2.705543454095404 / n)) AS upper FROM (SELECT lang, count(*)::DOUBLE AS n, avg(toxic) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang)")(
    lambda c: c.documents.select("doc_id", "lang").join(c.table("labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("toxic").alias("e")).select("lang", T.wilson_upper(F.col("e"), F.col("n")).alias("upper"))
)
query("f23_hash_sample", "SELECT doc_id FROM documents WHERE ('0x' || substr(sha256('7|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < 0.1")(lambda c: c.documents.filter(T.hash_fraction(F.lit("7"), F.col("doc_id")) < 0.1).select("doc_id"))
query("o07_hash_shuffle", "SELECT doc_id, sha256('seed|' || doc_id) AS k FROM documents ORDER BY k LIMIT 100")(lambda c: c.documents.select("doc_id", F.sha2(F.concat_ws("|", F.lit("seed"), F.col("doc_id").cast("string")), 256).alias("k")).orderBy("k").limit(100))
query("o08_adaptive_threshold", "SELECT min(n) AS threshold FROM (SELECT count(DISTINCT work_id) AS n FROM memberships GROUP BY item ORDER BY n DESC LIMIT 120)")(lambda c: c.memberships.groupBy("item").agg(F.countDistinct("work_id").alias("n")).orderBy(F.desc("n")).limit(120).agg(F.min("n").alias("threshold")))
query("o04_top_cited", "SELECT work_id, cited_by_count, year FROM works ORDER BY cited_by_count DESC, year DESC NULLS LAST, work_id LIMIT 15")(lambda c: c.works.orderBy(F.desc("cited_by_count"), F.desc_nulls_last("year"), "work_id").limit(15).select("work_id", "cited_by_count", "year"))
