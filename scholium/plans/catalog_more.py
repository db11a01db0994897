"""Further queries: statistics, review routing, diagnostics, graph algorithms, event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import diagnostics as D
from scholium.operators import evidence as E
from scholium.operators import graph as G
from scholium.operators import networks as N
from scholium.operators import programs as P
from scholium.operators import review as V
from scholium.operators import stats as X
from scholium.operators import aggregates as A
from scholium.operators import retrieval as R
from scholium.plans import canonical as C
from scholium.plans.catalog import _edges, _TOP15, query
from scholium.plans.corpus import Corpus
from scholium.session import cut
from scholium.sources import acquire, sinks
from scholium.streaming import ingest


def _labelled(c: Corpus) -> DataFrame:
    """labels with a simple rule's prediction beside them."""
    guess = (F.col("n_chars") >= 400).cast("int")
    return c.table("labels").join(c.documents.select("doc_id", "lang", "source", guess.alias("guess")), "doc_id")


_LAB = ", lab AS (SELECT l.*, lang, source, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS guess FROM labels l JOIN documents USING (doc_id))"

# ---- statistics ----

query("x04_holm", ", p AS (SELECT s_suppkey AS k, s_nationkey AS fam, (abs(s_acctbal) % 1000) / 20000.0 AS p FROM supplier) SELECT k, fam, p, least(1.0, max(raw) OVER (PARTITION BY fam ORDER BY p, k ROWS UNBOUNDED PRECEDING)) AS adjusted FROM (SELECT *, p * (count(*) OVER (PARTITION BY fam) - row_number() OVER (PARTITION BY fam ORDER BY p, k) + 1) AS raw FROM p)")(
    lambda c: X.holm(c.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("fam"), ((F.abs("s_acctbal") % 1000) / 20000.0).alias("p")), "k", "p", ["fam"])
)
query("x07_cohen_kappa", _LAB + ", t AS (SELECT lang, count(*)::DOUBLE AS n, avg(CASE WHEN quality = guess THEN 1.0 ELSE 0 END) AS po, avg(quality) * avg(guess) + (1 - avg(quality)) * (1 - avg(guess)) AS pe FROM lab GROUP BY lang) SELECT lang, CAST(n AS BIGINT) AS n, po AS agreement, CASE WHEN 1 - pe < 1e-12 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM t")(
    lambda c: X.cohen_kappa(_labelled(c), "quality", "guess", ["lang"])
)
query("x09_macro_f1", _LAB + ", z AS (SELECT v AS label, count(*) FILTER (WHERE quality = v) AS g, count(*) FILTER (WHERE guess = v) AS p, count(*) FILTER (WHERE quality = v AND guess = v) AS tp FROM lab, (SELECT unnest([0, 1]) AS v) GROUP BY v) SELECT avg(2.0 * tp / (g + p)) AS macro_f1, count(*) AS labels FROM z WHERE g + p > 0")(lambda c: X.macro_f1(_labelled(c), "quality", "guess"))
query("x16_prediction_scores", _LAB + " SELECT count(*) AS n, avg(CASE WHEN quality = guess THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) FILTER (WHERE quality = 1 AND guess = 1) / count(*) FILTER (WHERE quality = 1) AS recall, count(*) FILTER (WHERE quality = 0 AND guess = 1) / count(*) FILTER (WHERE quality = 0) AS false_intervention_rate, CAST(0 AS DOUBLE) AS abstention_rate FROM lab")(
    lambda c: X.prediction_scores(_labelled(c), "quality", "guess")
)
query("x14_paired_effect", _LAB + " SELECT source, avg(guess) FILTER (WHERE toxic = 1) - avg(guess) FILTER (WHERE toxic = 0) AS effect FROM lab GROUP BY source")(lambda c: X.paired_effect(_labelled(c), "source", "toxic", "guess", 1, 0))
query("x12_factorial", _LAB + ", k AS (SELECT lang, avg(length(source)) FILTER (WHERE quality = 0 AND guess = 0) AS c00, avg(length(source)) FILTER (WHERE quality = 0 AND guess = 1) AS c01, avg(length(source)) FILTER (WHERE quality = 1 AND guess = 0) AS c10, avg(length(source)) FILTER (WHERE quality = 1 AND guess = 1) AS c11 FROM lab GROUP BY lang) SELECT avg((c10 + c11 - c00 - c01) / 2) AS main_a, avg((c01 + c11 - c00 - c10) / 2) AS main_b, avg(c11 - c10 - c01 + c00) AS interaction, count(*) AS clusters FROM k")(
    lambda c: X.factorial_contrasts(_labelled(c).withColumn("v", F.length("source")), "lang", "quality", "guess", "v")
)
query("x17_nested_mean", _LAB + " SELECT avg(m) AS mean, count(*) AS datasets FROM (SELECT lang, avg(m) AS m FROM (SELECT lang, source, avg(guess) AS m FROM lab GROUP BY ALL) GROUP BY lang)")(lambda c: X.nested_mean(_labelled(c), "lang", "source", "guess"))
query("x08_krippendorff", _LAB + ", cells AS (SELECT source AS u, quality AS v, count(*) AS n FROM lab GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY u) AS m FROM cells QUALIFY m > 1), d AS (SELECT sum(a.n * b.n / (a.m - 1)) AS x FROM s a JOIN s b ON a.u = b.u AND a.v <> b.v), vs AS (SELECT v, sum(n) AS n FROM s GROUP BY v), e AS (SELECT sum(a.n * b.n) AS x FROM vs a JOIN vs b ON a.v <> b.v), t AS (SELECT sum(n) AS t FROM s) SELECT CAST(t AS BIGINT) AS ratings, CASE WHEN e.x = 0 THEN 1.0 ELSE 1 - (d.x / t) / (e.x / (t * (t - 1))) END AS alpha FROM d, e, t")(
    lambda c: X.krippendorff_alpha(_labelled(c), "source", "quality")
)
query("y04_fleiss_kappa", _LAB + ", cells AS (SELECT source AS u, quality AS v, count(*) AS n FROM lab GROUP BY ALL), i AS (SELECT u, sum(n) AS r, sum(n * (n - 1)) AS s FROM cells GROUP BY u HAVING sum(n) > 1), p AS (SELECT avg(s / (r * (r - 1))) AS po, sum(r) AS t, count(*) AS items FROM i), q AS (SELECT sum(n * n) AS q FROM (SELECT v, sum(n) AS n FROM cells WHERE u IN (SELECT u FROM i) GROUP BY v)) SELECT items, CASE WHEN 1 - q / (t * t) < 1e-12 THEN 1.0 ELSE (po - q / (t * t)) / (1 - q / (t * t)) END AS kappa FROM p, q")(
    lambda c: X.fleiss_kappa(_labelled(c), "source", "quality")
)
query("w15_aurc", _LAB + ", r AS (SELECT lang, sum(CASE WHEN quality <> guess THEN 1.0 ELSE 0 END) OVER w / count(*) OVER w AS s FROM lab WINDOW w AS (PARTITION BY lang ORDER BY doc_id % 97, doc_id ROWS UNBOUNDED PRECEDING)) SELECT lang, avg(s) AS aurc, count(*) AS cases FROM r GROUP BY lang")(
    lambda c: X.aurc(_labelled(c).withColumn("risk", F.col("doc_id") % 97).withColumn("error", (F.col("quality") != F.col("guess")).cast("int")), ["lang"], "risk", "error", "doc_id")
)
_FLIPS = ", f AS (SELECT i, sum(CASE WHEN (i >> CAST(j AS INTEGER)) & 1 = 1 THEN -x ELSE x END) AS s FROM (SELECT row_number() OVER (ORDER BY k) - 1 AS j, x FROM e), (SELECT unnest(range(0, CAST(pow(2, (SELECT count(*) FROM e)) AS BIGINT))) AS i) GROUP BY i), o AS (SELECT sum(x) AS s, avg(x) AS m FROM e)"


def _effects(c: Corpus) -> DataFrame:
    nation = c.table("nation").select(F.col("n_nationkey").alias("s_nationkey"))
    return c.table("supplier").join(nation, "s_nationkey").groupBy("s_nationkey").agg((F.avg("s_acctbal") / 1000).alias("x"))


query(
    "x03_sign_flip_regions",
    ", e AS (SELECT n_regionkey AS k, avg(s_acctbal) / 1000 AS x FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)" + _FLIPS + " SELECT avg(CASE WHEN abs(f.s) >= abs(o.s) - 1e-9 THEN 1.0 ELSE 0 END) AS p_two_sided, avg(CASE WHEN f.s >= o.s - 1e-9 THEN 1.0 ELSE 0 END) AS p_greater, count(*) AS patterns, any_value(o.m) AS mean FROM f, o",
)(lambda c: X.sign_flip_test(c.table("supplier").join(c.table("nation"), F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_regionkey").agg((F.avg("s_acctbal") / 1000).alias("x")), "x"))
query("x05_mcnemar")(lambda c: X.mcnemar(_labelled(c).select((F.col("quality") == 1).alias("a"), (F.col("guess") == 1).alias("b")), "a", "b"))
query("x01_cluster_bootstrap")(lambda c: X.cluster_bootstrap(c.table("supplier").join(c.table("nation"), F.col("n_nationkey") == F.col("s_nationkey")).groupBy("s_nationkey").agg((F.avg("s_acctbal") / 1000).alias("x")), "x"))
query("x11_randomization")(lambda c: X.randomization_test(c.table("supplier").withColumn("arm", F.col("s_suppkey") % 2), "s_suppkey", "arm", "s_acctbal", 500))
query("x15_power")(lambda c: X.power_simulation(c.spark, 6, 0.8, 500))
query("y02_equivalence")(lambda c: X.equivalence_test(_effects(c), "x", 5.0))
query("y10_family_summary", "SELECT o_orderpriority AS family, o_orderstatus AS measure, min(o_totalprice) AS low, max(o_totalprice) AS high, avg(o_totalprice) AS mean, count(o_totalprice) AS n FROM orders GROUP BY ALL")(
    lambda c: X.family_summary(c.table("orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("measure"), "o_totalprice"), "family", "measure", "o_totalprice")
)

# ---- review ----

query("v03_capability", _LAB + ", g AS (SELECT source AS reviewer, lang AS domain, toxic AS issue, grouping(source, lang, toxic) AS g, count(*) AS n, sum(CASE WHEN quality = guess THEN 1 ELSE 0 END) AS k FROM lab GROUP BY GROUPING SETS ((source, lang, toxic), (source, toxic), (source, lang), (source), ())) SELECT reviewer, domain, issue, CASE g WHEN 0 THEN 'exact' WHEN 2 THEN 'issue' WHEN 1 THEN 'domain' WHEN 3 THEN 'reviewer' ELSE 'all' END AS level, n, (k + 1.0) / (n + 2.0) AS accuracy, n >= 5 AS usable FROM g")(
    lambda c: V.capability(_labelled(c).select(F.col("source").alias("reviewer"), F.col("lang").alias("domain"), F.col("toxic").alias("issue"), (F.col("quality") == F.col("guess")).cast("int").alias("correct")))
)
query("v13_resolution", _LAB + ", r AS (SELECT source AS item_id, count(DISTINCT lang) AS reviewers, count(DISTINCT quality) AS labels, min(quality) AS label FROM lab GROUP BY source), a AS (SELECT source AS item_id, max(toxic) AS final FROM lab GROUP BY source HAVING count(*) > 20) SELECT item_id, CASE WHEN reviewers >= 2 AND labels = 1 THEN 'agreed' WHEN final IS NOT NULL THEN 'adjudicated' ELSE 'open' END AS status, CASE WHEN reviewers >= 2 AND labels = 1 THEN label ELSE final END AS label FROM r LEFT JOIN a USING (item_id)")(
    lambda c: V.resolve(_labelled(c).select(F.col("source").alias("item_id"), F.col("lang").alias("reviewer"), F.col("quality").alias("label")), _labelled(c).groupBy(F.col("source").alias("item_id")).agg(F.max("toxic").alias("label"), F.count(F.lit(1)).alias("n")).filter("n > 20"))
)
query("v14_conflicts", _LAB + " SELECT source AS item_id, list_sort(list(DISTINCT quality)) AS labels, count(DISTINCT lang) AS judges FROM lab GROUP BY source HAVING count(DISTINCT quality) > 1 AND count(DISTINCT lang) > 1")(
    lambda c: V.conflicts(_labelled(c).select(F.col("source").alias("item_id"), F.col("lang").alias("judge"), F.col("quality").alias("label")))
)
query("a29_judge_totals", _LAB + " SELECT lang AS condition, count(*) AS n, count(*) FILTER (WHERE quality > guess) AS wins, count(*) FILTER (WHERE quality = guess) AS ties, (count(*) FILTER (WHERE quality > guess) + count(*) FILTER (WHERE quality = guess) / 2.0) / count(*) AS preference FROM lab GROUP BY lang")(
    lambda c: V.judge_totals(_labelled(c).select(F.col("lang").alias("condition"), F.when(F.col("quality") > F.col("guess"), "win").when(F.col("quality") == F.col("guess"), "tie").otherwise("loss").alias("outcome")))
)
query("v11_balanced_sample", ", r AS (SELECT doc_id, source, sha256('s|' || doc_id) AS o, sha256('s|' || source) AS q, row_number() OVER (PARTITION BY source ORDER BY sha256('s|' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS size FROM documents), t AS (SELECT * FROM r ORDER BY rn, q, doc_id LIMIT 150) SELECT doc_id, source, size / (count(*) OVER (PARTITION BY source)) AS weight FROM t")(
    lambda c: V.balanced_sample(c.documents, "doc_id", "source", 150, "s")
)
query("v02_issue_flags", ", s AS (SELECT lang AS key, avg(CASE WHEN n_chars >= 400 THEN 1.0 ELSE 0 END) AS coverage, count(DISTINCT source) / 100.0 AS diversity FROM documents GROUP BY lang) SELECT key, 'coverage' AS issue, 'major' AS severity FROM s WHERE coverage < 0.9 UNION ALL SELECT key, 'diversity', 'minor' FROM s WHERE diversity < 0.5")(
    lambda c: V.issue_flags(c.documents.groupBy(F.col("lang").alias("key")).agg(F.avg((F.col("n_chars") >= 400).cast("double")).alias("coverage"), (F.countDistinct("source") / 100).alias("diversity")), {"coverage": ("coverage", 0.9, "major"), "diversity": ("diversity", 0.5, "minor")})
)
query("v17_leak_scan", "SELECT doc_id, list_filter(['all rights', 'license'], lambda t: contains(regexp_replace(lower(text), '[\\s_-]+', ' ', 'g'), t)) AS terms FROM documents WHERE len(terms) > 0")(lambda c: V.leak_scan(c.documents, "doc_id", "text", ["all rights", "license"]))
query("v01_adaptive_policy")(lambda c: V.adaptive_policy(c.documents.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("issue"), F.lit("minor").alias("severity")), _labelled(c).select(F.col("lang").alias("issue"), F.col("source").alias("dataset"), F.col("quality").alias("accepted"))))
query("o09_greedy_budget")(lambda c: V.greedy_budget(c.works.select(F.col("document_type").alias("g"), F.col("work_id").alias("target_id"), F.col("cited_by_count").alias("priority"), (F.col("work_id") % 9 + 1).cast("double").alias("cost"), (F.col("work_id") % 5000 == 0).alias("mandatory")), "g", 500.0))

# ---- diagnostics ----

query("n01_article_diagnostics")(lambda c: D.article_diagnostics(c.documents, "doc_id", "text"))
query("n04_summary", ", s AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS words FROM documents) SELECT 'words' AS metric, avg(words) AS mean, quantile_cont(CAST(words AS DOUBLE), 0.5) AS median FROM s")(lambda c: D.summarize(c.documents.select(F.size(D.words(F.coalesce("text", F.lit("")))).alias("words")), ["words"]))
query("n05_paragraphs", ", p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents), q AS (SELECT doc_id, p, unnest(range(0, len(p))) AS i FROM p) SELECT doc_id, CAST(i AS INTEGER) AS paragraph, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x) + 1)), 0) AS INTEGER) AS start, p[i + 1] AS body FROM q WHERE trim(p[i + 1]) <> ''")(lambda c: D.paragraphs(c.documents, "doc_id", "text"))
query("n02_near_duplicate_paragraphs", ", p AS (SELECT doc_id, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i, string_split(coalesce(text, ''), chr(10)) AS ps FROM documents), w AS (SELECT doc_id, i, regexp_extract_all(lower(ps[i + 1]), '[a-z0-9]+') AS w FROM p WHERE trim(ps[i + 1]) <> ''), s AS (SELECT DISTINCT doc_id, i, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM w WHERE len(w) > 0), n AS (SELECT doc_id, i, count(*) AS n FROM s GROUP BY ALL), c AS (SELECT a.doc_id, a.i AS l, b.i AS r, count(*) AS c FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i GROUP BY ALL) SELECT c.doc_id, CAST(l AS INTEGER) AS \"left\", CAST(r AS INTEGER) AS \"right\", round(c / (x.n + y.n - c), 6) AS similarity FROM c JOIN n x ON x.doc_id = c.doc_id AND x.i = l JOIN n y ON y.doc_id = c.doc_id AND y.i = r WHERE c / (x.n + y.n - c) >= 0.8")(
    lambda c: D.near_duplicate_paragraphs(c.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph", "body")).filter(F.trim("body") != ""), "doc_id", "paragraph", "body")
)
query("n03_opening_repeats")(lambda c: D.opening_repeats(c.documents, "doc_id", "text"))
query("n03_section_entropy", ", s AS (SELECT lang, source, sum(n_chars) AS n FROM documents GROUP BY ALL), p AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM s) SELECT lang, CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0.0 END AS entropy FROM p GROUP BY lang")(lambda c: D.section_entropy(c.documents, "lang", "source", "n_chars"))

# ---- graph algorithms ----


def _net(c: Corpus, pool: int = 500) -> DataFrame:
    return N.cooccurrence(c.memberships, "work_id", "item", pool).filter("weight >= 2")


query("g17_components", _edges("memberships", "work_id", "item", 2000) + ", s AS (SELECT source, target FROM e WHERE weight >= 2), b AS (SELECT source AS a, target AS b FROM s UNION ALL SELECT target, source FROM s), r(n, m) AS (SELECT DISTINCT a, a FROM b UNION SELECT r.n, b.b FROM r JOIN b ON r.m = b.a) SELECT n AS node, min(m) AS component FROM r GROUP BY n", recursive=True)(
    lambda c: G.connected_components(c.spark, _net(c, 2000))
)
query("g18_hops", _edges("memberships", "work_id", "item", 200) + ", b AS (SELECT source AS a, target AS b FROM e UNION ALL SELECT target, source FROM e), s AS (SELECT min(source) AS start FROM e), h1 AS (SELECT DISTINCT start, b AS node FROM s JOIN b ON a = start), h2 AS (SELECT DISTINCT start, b.b AS node FROM h1 JOIN b ON a = h1.node) SELECT start, node, CAST(min(h) AS INTEGER) AS hops FROM (SELECT start, start AS node, 0 AS h FROM s UNION ALL SELECT start, node, 1 FROM h1 UNION ALL SELECT start, node, 2 FROM h2) GROUP BY ALL")(
    lambda c: G.hops(c.spark, (e := N.cooccurrence(c.memberships, "work_id", "item", 200)), e.agg(F.min("source").alias("start")), 2)
)
query("g15_betweenness")(lambda c: G.betweenness(_net(c).withColumn("graph", F.lit("items")), "graph"))
query("g12_communities")(lambda c: G.communities(_net(c).withColumn("graph", F.lit("items")), "graph"))
query("g16_spanning_forest")(lambda c: G.spanning_forest(_net(c).withColumn("graph", F.lit("items")), "graph"))
query("g27_adjusted_rand", ", l AS (SELECT s_nationkey % 5 AS a, s_suppkey % 3 AS b FROM supplier), c AS (SELECT a, b, count(*) AS n FROM l GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2.0) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2.0) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY b)), z AS (SELECT sum(n * (n - 1) / 2.0) AS z, sum(n) * (sum(n) - 1) / 2.0 AS t FROM c) SELECT (z - x * y / t) / ((x + y) / 2 - x * y / t) AS ari FROM x, y, z")(
    lambda c: G.adjusted_rand(c.table("supplier").select((F.col("s_nationkey") % 5).alias("a"), (F.col("s_suppkey") % 3).alias("b")), "a", "b")
)
query("r09_programs")(lambda c: P.run_programs(_net(c).withColumn("graph", F.lit("items")), N.candidates(c.memberships, "work_id", "item", 500).select(F.lit("items").alias("graph"), F.col("item").alias("node"), "occurrences"), "graph"))
query("r07_temporal_shift", f", t AS (SELECT keyword, year, count(DISTINCT work_id) AS works FROM keywords JOIN works USING (work_id) WHERE keyword IN {_TOP15} GROUP BY ALL), y AS (SELECT min(year) AS y0, max(year) AS y1 FROM t) SELECT keyword, CAST(sum(CASE WHEN year < y0 + 3 THEN works ELSE 0 END) AS BIGINT) AS early, CAST(sum(CASE WHEN year > y1 - 3 THEN works ELSE 0 END) AS BIGINT) AS recent, (recent + 1) / (early + 1) AS growth FROM t, y GROUP BY keyword")(
    lambda c: P.temporal_shift(A.term_trend(c.works, c.keywords, "keyword"), "keyword")
)
query("d23_scope_audit", ", t AS (SELECT item FROM memberships GROUP BY item ORDER BY count(DISTINCT work_id) DESC, item LIMIT 300), m AS (SELECT DISTINCT work_id, item FROM memberships), k AS (SELECT * FROM m WHERE item IN (FROM t)), a AS (SELECT sum(n) AS rows, sum(n * (n - 1) // 2) AS mass FROM (SELECT count(*) AS n FROM m GROUP BY work_id)), b AS (SELECT sum(n) AS r, sum(n * (n - 1) // 2) AS q FROM (SELECT count(*) AS n FROM k GROUP BY work_id)) SELECT CAST(rows AS BIGINT) AS rows, CAST(mass AS BIGINT) AS mass, (SELECT count(DISTINCT item) FROM m) AS items, r / rows AS membership_share, q / mass AS mass_share, (SELECT count(DISTINCT item) FROM k) / (SELECT count(DISTINCT item) FROM m) AS item_share FROM a, b")(
    lambda c: C.scope_audit(c.memberships, N.candidates(c.memberships, "work_id", "item", 300), "work_id", "item")
)
query("s20_date_slices", ", d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT *, CAST(floor(coalesce(sum(n) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000) AS BIGINT) AS slice FROM d) SELECT slice, min(day) AS first_day, max(day) AS last_day, CAST(sum(n) AS BIGINT) AS expected FROM s GROUP BY slice")(
    lambda c: acquire.cumulative_slices(c.table("orders").select(F.to_date("o_orderdate").alias("d")), "d", 1000)
)
query("s22_record_ledger", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1 AS first FROM events")(lambda c: acquire.record_ledger(c.table("events").withColumn("k", F.concat_ws("|", "event_type", "user_id")), "k", ["ts", "event_id"]).select("event_type", "event_id", "first"))
query("s26_vosviewer", _edges("memberships", "work_id", "item", 200) + ", n AS (SELECT item AS id, count(DISTINCT work_id) AS o FROM memberships WHERE item IN (FROM top) GROUP BY item), k AS (SELECT id, row_number() OVER (ORDER BY o DESC, id) AS number FROM n) SELECT least(a.number, b.number) AS first, greatest(a.number, b.number) AS second, weight FROM e JOIN k a ON a.id = source JOIN k b ON b.id = target")(
    lambda c: sinks.vosviewer(N.candidates(c.memberships, "work_id", "item", 200).select(F.col("item").alias("id"), F.col("item").cast("string").alias("label"), "occurrences", F.lit(1).alias("cluster")), N.cooccurrence(c.memberships, "work_id", "item", 200))[1]
)
def _synthetic(c: Corpus, n: int = 2000) -> DataFrame:
    """Quality gate of a synthetic corpus; the tables are cut once, as the gate reads each several times."""
    tables = C.canonicalize(c.spark, [C.crossref(cut(c.spark, C.synthetic_records(c.spark, n)))], 2020, 2025)
    return C.quality_gate({t: cut(c.spark, df) for t, df in tables.items()}, n, 2020, 2025)


query("d27_synthetic_canonical")(_synthetic)
query("t02_tfidf_cosine")(lambda c: R.top_ranked(R.tfidf_cosine(c.documents, "doc_id", "text", "licensed under the license all rights reserved"), "doc_id", 50))
query("f01_clean_pages", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages")(lambda c: c.table("pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " ")).alias("body")))
query("f20_evidence_ids")(lambda c: c.documents.select("doc_id", T.evidence_ids(F.concat(F.lit("see E001-E004 and E"), F.lpad((F.col("doc_id") % 900).cast("string"), 3, "0"))).alias("ids")))

# ---- event time (Spark extras, not derived from the reference) ----

query("m_tumbling_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL")(lambda c: ingest.tumbling_counts(c.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")).withColumn("start", F.col("start").cast("timestamp_ntz")))
query("m_sessions", ", x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS events FROM y GROUP BY user_id, s")(
    lambda c: ingest.sessions(c.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
)

# ---- evidence ----

query("d30_representative_works", ", l AS (SELECT DISTINCT keyword AS label FROM keywords), r AS (SELECT DISTINCT label, work_id FROM keywords JOIN l ON lower(trim(keyword)) = lower(trim(label))) SELECT label, work_id, row_number() OVER (PARTITION BY label ORDER BY cited_by_count DESC NULLS LAST, year DESC NULLS LAST, work_id) AS rank FROM r JOIN works USING (work_id) QUALIFY rank <= 3")(
    lambda c: E.representative_works(c.works, c.keywords, c.keywords.select(F.col("keyword").alias("label")).distinct())
)
query("d25_temporal_vectors", f", t AS (SELECT keyword, year, count(DISTINCT work_id) AS works FROM keywords JOIN works USING (work_id) WHERE keyword IN {_TOP15} GROUP BY ALL) SELECT keyword, array_to_string([" + ", ".join(f"CAST(coalesce(sum(works) FILTER (WHERE year = {y}), 0) AS BIGINT)" for y in range(1995, 2002)) + "], ',') AS counts FROM t GROUP BY keyword")(
    lambda c: E.temporal_vectors(A.term_trend(c.works, c.keywords, "keyword"), "keyword", list(range(1995, 2002))).select("keyword", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))
)
query("d22_identity_audit", "SELECT 'customer' AS \"table\", count(*) FILTER (WHERE c_name IS NULL OR regexp_matches(lower(trim(c_name)), '(^|[:/])\\s*(none|null|nan|)/?$')) AS bad_rows, count(DISTINCT c_name) FILTER (WHERE regexp_matches(lower(trim(c_name)), '(^|[:/])\\s*(none|null|nan|)/?$')) AS bad_ids FROM customer UNION ALL SELECT 'pages', count(*) FILTER (WHERE url IS NULL OR regexp_matches(lower(trim(url)), '(^|[:/])\\s*(none|null|nan|)/?$')), count(DISTINCT url) FILTER (WHERE regexp_matches(lower(trim(url)), '(^|[:/])\\s*(none|null|nan|)/?$')) FROM pages")(
    lambda c: E.identity_audit({"customer": (c.table("customer"), "c_name"), "pages": (c.table("pages"), "url")})
)
query("a31_claim_quality", _LAB + ", n AS (SELECT source AS condition, count(*) FILTER (WHERE quality = 1) AS g, count(*) FILTER (WHERE quality = 0) AS b FROM lab GROUP BY source), w AS (SELECT source AS condition, sum(n_chars) AS w, count(*) AS articles FROM documents GROUP BY source) SELECT condition, articles, 1000 * coalesce(g, 0) / w AS supported_per_1000, 1000 * coalesce(b, 0) / w AS unsupported_per_1000 FROM w LEFT JOIN n USING (condition)")(
    lambda c: E.normalized_claim_quality(c.table("labels").select(F.col("doc_id").alias("article"), (F.col("quality") == 1).alias("supported")), c.documents.select(F.col("doc_id").alias("article"), F.col("source").alias("condition"), F.col("n_chars").alias("words")))
)
query("o10_word_budget")(lambda c: E.word_budget(c.table("conversations").select("conv_id", F.col("turn").alias("position"), F.size(F.split("text", r"\s+")).cast("long").alias("words"), F.length("text").cast("double").alias("value"), (F.col("turn") == 0).alias("required")), "conv_id", 60))
query("d20_unexpected_numbers")(lambda c: E.unexpected_numbers(c.documents, "doc_id", "text", c.documents.select((F.col("doc_id") % 10).cast("string").alias("number"))))
query("t04_latent_vectors")(lambda c: R.latent_vectors(c.documents, "doc_id", "text", 8, 512).select("doc_id", F.size("vector").alias("dimensions")))
