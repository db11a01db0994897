"""Queries over network selections, prediction scores, ablations and review priorities, with their DuckDB SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.operators import ablation as B
from scholium.operators import aggregates as A
from scholium.operators import networks as N
from scholium.operators import selection as S
from scholium.plans.catalog import _PAIRS, _TOP15, _edges, query
from scholium.plans.corpus import Corpus
from scholium.session import cut

# ---- networks ----

query("g05_coupling_capped", f""", o AS (SELECT citing_work_id, count(DISTINCT cited_work_id) AS occurrences FROM refs GROUP BY 1 HAVING count(DISTINCT cited_work_id) >= 2 ORDER BY occurrences DESC, citing_work_id LIMIT 500),
m AS (SELECT * FROM (SELECT DISTINCT citing_work_id, cited_work_id FROM refs) JOIN o USING (citing_work_id) QUALIFY row_number() OVER (PARTITION BY cited_work_id ORDER BY occurrences DESC, citing_work_id) <= 100),
e AS ({_PAIRS.format(g="cited_work_id", i="citing_work_id")})
SELECT source, target, weight, weight / (a.occurrences * b.occurrences) AS association_strength FROM e JOIN o a ON a.citing_work_id = source JOIN o b ON b.citing_work_id = target""")(
    lambda c: S.coupling(c.references, 500)[1]
)


def _display(c: Corpus) -> DataFrame:
    edges = cut(c.spark, N.cooccurrence(c.memberships, "work_id", "item"))  # read four times
    nodes = N.candidates(c.memberships, "work_id", "item", 500)
    weighed = N.degrees(edges).join(nodes.withColumnRenamed("item", "node"), "node").select("node", "occurrences", "weighted_degree")
    return S.display_selection(weighed, N.association(edges, nodes, "item"), 80)


query("g11_display_selection", _edges("memberships", "work_id", "item", 500) + """, o AS (SELECT item, count(DISTINCT work_id) AS occurrences FROM memberships WHERE item IN (FROM top) GROUP BY item),
g AS (SELECT node, sum(weight) AS d FROM (SELECT source AS node, weight FROM e UNION ALL SELECT target, weight FROM e) GROUP BY node),
n AS (SELECT node FROM g JOIN o ON item = node ORDER BY round(d + sqrt(occurrences) / 4, 9) DESC, node LIMIT 80),
z AS (SELECT source, target, weight, weight / (a.occurrences * b.occurrences) AS association_strength FROM e JOIN o a ON a.item = source JOIN o b ON b.item = target WHERE source IN (FROM n) AND target IN (FROM n)),
s AS (SELECT *, row_number() OVER (ORDER BY round(association_strength * ln(1 + weight), 12) DESC, source, target) AS k FROM z),
b AS (SELECT k, source AS x, target AS y FROM s UNION ALL SELECT k, target, source FROM s),
reach(k, node) AS (SELECT k, source FROM s UNION SELECT reach.k, b.y FROM reach JOIN b ON b.x = reach.node AND b.k < reach.k),
t AS (SELECT count(*) AS n FROM n)
SELECT * FROM (SELECT source, target, weight, association_strength, k <= greatest(2 * t.n, least(3 * t.n, 280)) AS strong, NOT EXISTS (SELECT 1 FROM reach WHERE reach.k = s.k AND reach.node = s.target) AS backbone FROM s, t) WHERE strong OR backbone""", recursive=True)(_display)


def _items(c: Corpus) -> DataFrame:
    return N.cooccurrence(c.memberships, "work_id", "item").filter("weight >= 2").withColumn("graph", F.lit("items"))


query("g13_merged_communities")(lambda c: S.merged_communities(_items(c), "graph", 5))


def _asked(c: Corpus) -> DataFrame:
    held = c.authorships.filter("institution_id IS NOT NULL")
    named = c.table("nation").select(F.col("n_nationkey").cast("long").alias("institution_id"), F.col("n_name").alias("label"))
    nodes = N.candidates(held, "work_id", "institution_id", 500).join(named, "institution_id").select(F.lit("institutions").alias("graph"), F.col("institution_id").alias("node"), "label", F.col("occurrences").alias("importance"))
    edges = N.cooccurrence(held, "work_id", "institution_id").withColumn("graph", F.lit("institutions"))
    return S.anchored_records(edges, nodes, "Which works link 'NATION_7' to 'NATION_12'?", 24, "long")


query("t06_anchored_records")(_asked)

# ---- predictions and ablations ----

_LAB = ", lab AS (SELECT l.*, lang, source, n_chars FROM labels l JOIN documents USING (doc_id))"


def _lab(c: Corpus) -> DataFrame:
    return c.table("labels").join(c.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")


def _scored(c: Corpus) -> DataFrame:
    lab = _lab(c)
    items = lab.select(F.col("doc_id").alias("item_id"), "source", (F.col("toxic") == 0).alias("answerable"), F.col("lang").alias("answer"), F.concat(F.lit("Its source is "), "source").alias("statement"), F.array("lang", "source").alias("evidence"))
    said = F.when(F.col("lang") == "en", F.concat(F.lit(" its  SOURCE is "), "source", F.lit(" ."))).when(F.col("lang") == "de", F.lit("{}")).when(F.col("lang") == "fr", F.lit("no source"))
    cited = F.when(F.col("lang") == "es", F.array("lang", F.lit("other"))).otherwise(F.array("lang", "source", "source"))
    predictions = lab.filter("quality = 1").select(F.col("doc_id").alias("item_id"), (F.col("n_chars") < 400).alias("abstain"), F.when(F.col("lang") != "es", F.lit("en")).alias("answer"), said.alias("statement"), cited.alias("evidence"))
    return B.score_predictions(items, predictions)


query("a28_prediction_summary", _LAB + """, p AS (SELECT *, quality = 1 AS held, quality = 1 AND (n_chars < 400 OR lang <> 'es') AS valid, quality = 1 AND n_chars < 400 AS abstained, toxic = 0 AS answerable FROM lab),
q AS (SELECT *, CASE WHEN answerable THEN valid AND NOT abstained AND lang = 'en' ELSE abstained END AS correct, held AND NOT abstained AND lang IN ('en', 'fr') AS claim,
CASE WHEN NOT held THEN 0 WHEN lang = 'es' THEN 1 ELSE len(list_distinct([lang, source])) END AS tp, CASE WHEN held AND lang = 'es' THEN 1 ELSE 0 END AS fp, len(list_distinct([lang, source])) AS gold FROM p),
r AS (SELECT *, gold - tp AS fn, claim AND answerable AND lang = 'en' AS supported, CASE WHEN NOT abstained THEN held AND fp = 0 END AS path FROM q),
s AS (SELECT source, count(*) AS items, avg(CASE WHEN correct THEN 1.0 ELSE 0 END) AS accuracy, avg(CASE WHEN valid THEN 1.0 ELSE 0 END) AS schema_valid_rate,
coalesce(count(*) FILTER (WHERE claim AND NOT supported) / nullif(count(*) FILTER (WHERE claim), 0), 0.0) AS unsupported_claim_rate,
coalesce(count(*) FILTER (WHERE NOT abstained AND NOT correct) / nullif(count(*) FILTER (WHERE NOT abstained), 0), 0.0) AS unsupported_answer_rate,
coalesce(count(*) FILTER (WHERE claim) / nullif(count(*) FILTER (WHERE answerable), 0), 0.0) AS statement_claim_coverage,
coalesce(count(*) FILTER (WHERE path) / nullif(count(path), 0), 0.0) AS evidence_path_validity,
CASE WHEN sum(tp + fp) > 0 THEN sum(tp) / sum(tp + fp) WHEN sum(fn) > 0 THEN 0.0 ELSE 1.0 END AS evidence_precision, coalesce(sum(tp) / nullif(sum(tp + fn), 0), 1.0) AS evidence_recall,
coalesce(count(*) FILTER (WHERE abstained AND NOT answerable) / nullif(count(*) FILTER (WHERE NOT answerable), 0), 0.0) AS abstention_precision,
coalesce(count(*) FILTER (WHERE abstained AND NOT answerable) / nullif(count(*) FILTER (WHERE abstained), 0), 0.0) AS abstention_recall FROM r GROUP BY source)
SELECT *, CASE WHEN abstention_precision + abstention_recall > 0 THEN 2 * abstention_precision * abstention_recall / (abstention_precision + abstention_recall) ELSE 0.0 END AS abstention_f1 FROM s""")(
    lambda c: B.prediction_summary(_scored(c), ["source"])
)


def _conditions(c: Corpus) -> tuple[DataFrame, DataFrame]:
    lab = _lab(c).withColumnRenamed("doc_id", "item_id")
    return lab.select("item_id", "lang", (F.col("quality") == F.when(F.col("n_chars") >= 400, 1).otherwise(0)).alias("correct")), lab.select("item_id", (F.col("quality") == 1).alias("correct"))


query("x06_paired_ablation", _LAB + """, p AS (SELECT lang, (quality = CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END)::INT AS a, (quality = 1)::INT AS b FROM lab)
SELECT lang, count(*) AS items, avg(a) AS first_accuracy, avg(b) AS second_accuracy, avg(a - b) AS difference, count(*) FILTER (WHERE a > b) AS first_only, count(*) FILTER (WHERE a < b) AS second_only FROM p GROUP BY lang""")(
    lambda c: B.paired_ablation(*_conditions(c), ["lang"])
)


def _intervals(c: Corpus) -> DataFrame:
    a, b = _conditions(c)
    return B.ablation_interval(a.withColumnRenamed("correct", "a").join(b.withColumnRenamed("correct", "b"), "item_id"), "lang", "a", "b")


query("x06_ablation_interval")(_intervals)
query("x10_topic_bootstrap", """, a AS (SELECT s_nationkey AS t, l_orderkey AS x, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
s AS (SELECT row_number() OVER (ORDER BY t) - 1 AS pick, sum(n) AS n, sum(k) AS k, count(*) AS m, count(*) FILTER (WHERE k > 0) AS j FROM a GROUP BY t),
d AS (SELECT r, ('0x' || md5('20260908|' || r || '|' || i)[1:8])::BIGINT % (SELECT count(*) FROM s) AS pick FROM range(0, 5000) u(r), range(0, (SELECT count(*) FROM s)) v(i)),
q AS (SELECT r, sum(k) / sum(n) AS row, sum(j) / sum(m) AS article FROM d JOIN s USING (pick) GROUP BY r),
l AS (SELECT list_sort(list(row)) AS row, list_sort(list(article)) AS article FROM q) SELECT row[125] AS row_low, row[4875] AS row_high, article[125] AS article_low, article[4875] AS article_high FROM l""")(
    lambda c: B.topic_bootstrap(c.table("lineitem").join(c.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey"), "s_nationkey", "l_orderkey", F.col("l_returnflag") == "R")
)


def _fractions(c: Corpus) -> DataFrame:
    shares = {"before": -900, "after": 0, "varied_before": 500, "varied_after": 2500}
    return c.table("customer").groupBy("c_nationkey").agg(*[F.avg((F.col("c_acctbal") > v).cast("double")).alias(k) for k, v in shares.items()])


query("y11_deletion_decomposition", """, f AS (SELECT c_nationkey, avg((c_acctbal > -900)::INT) AS before, avg((c_acctbal > 0)::INT) AS after, avg((c_acctbal > 500)::INT) AS varied_before, avg((c_acctbal > 2500)::INT) AS varied_after FROM customer GROUP BY 1)
SELECT *, before - after AS base_loss, varied_before - varied_after AS varied_loss, varied_before - before AS change_before, (varied_before - varied_after) - (before - after) AS additional_loss, varied_after - after AS total_change FROM f""")(
    lambda c: B.deletion_decomposition(_fractions(c))
)
query("y12_swapped_windows", f""", t AS (SELECT keyword, year, count(DISTINCT work_id) AS works FROM keywords JOIN works USING (work_id) WHERE keyword IN {_TOP15} AND year IS NOT NULL GROUP BY ALL),
y AS (SELECT list_sort(list(DISTINCT year)) AS ys FROM t), p AS (SELECT *, list_position(ys, year) AS i, len(ys) AS n FROM t, y)
SELECT keyword, works, CASE WHEN i <= 3 THEN ys[n - 3 + i] WHEN i > n - 3 THEN ys[i - (n - 3)] ELSE year END AS year FROM p""")(
    lambda c: B.swap_windows(A.term_trend(c.works, c.keywords, "keyword"))
)


def _tasks(c: Corpus) -> DataFrame:
    return c.works.groupBy(F.col("document_type").alias("task"), F.col("language").alias("scale")).agg(F.min("year").alias("first"), F.max("year").alias("last"))


query("y13_scale_pairs", """, t AS (SELECT document_type AS task, language AS scale, min(year) AS first, max(year) AS last FROM works GROUP BY ALL)
SELECT task, min(first) AS first, min(last) AS last FROM t WHERE scale IN ('F', 'O', 'P') GROUP BY task HAVING count(DISTINCT scale) = 3 AND count(DISTINCT (first, last)) = 1""")(
    lambda c: B.scale_pairs(_tasks(c), "task", "scale", ["first", "last"], ["F", "O", "P"])
)

# ---- review ----

_TYPED = """SELECT event_id AS feedback_id, CASE event_id % 4 WHEN 0 THEN 'evidence' WHEN 1 THEN 'operator' WHEN 2 THEN 'plan' ELSE 'claim' END AS target_type,
CASE event_id % 7 WHEN 0 THEN 'accept' WHEN 1 THEN 'rewrite' WHEN 2 THEN 'abstain' WHEN 3 THEN 'reject_claim' WHEN 4 THEN 'reject_evidence' WHEN 5 THEN 'reject_operator' ELSE 'reject_plan' END AS action,
event_type AS replacement FROM events"""
query("v10_feedback_credit", f""", f AS ({_TYPED}), g AS (SELECT *, action = 'abstain' OR starts_with(action, 'reject_') AND action <> 'reject_' || target_type AS away FROM f)
SELECT feedback_id, CASE WHEN away THEN 'risk_router' WHEN target_type = 'evidence' THEN 'retriever' WHEN target_type = 'claim' THEN 'generator' ELSE 'planner' END AS component,
CASE WHEN action = 'reject_' || target_type THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS reward, CASE WHEN away THEN 'escalation' WHEN action = 'rewrite' THEN 'pairwise_preference' ELSE 'pointwise' END AS supervision,
CASE WHEN action = 'rewrite' THEN replacement END AS preferred FROM g""")(
    lambda c: B.feedback_credit(c.spark.sql(_TYPED.replace("FROM events", "FROM {t}"), t=c.table("events")))
)


def _priority(c: Corpus) -> DataFrame:
    customer = c.table("customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("issue"), F.col("c_nationkey").cast("string").alias("guard"), "c_acctbal")
    feedback = c.works.join(customer, "source_id").select("issue", F.when(F.col("language") != "P", F.col("guard")).alias("guard"), F.when(F.col("language") == "F", "accept").otherwise("reject_claim").alias("action"))
    severity = F.when(F.col("c_acctbal") < 0, "critical").when(F.col("c_acctbal") < 2000, "high").when(F.col("c_acctbal") < 5000, "medium").otherwise("low")
    counts = c.works.groupBy("source_id").agg(F.count(F.lit(1)).alias("k"))
    targets = customer.join(counts, "source_id", "left").select(F.col("source_id").alias("target_id"), "issue", "guard", severity.alias("severity"), F.coalesce("k", F.lit(0)).alias("descendants"), F.lit(30.0).alias("seconds"))
    return B.review_priority(targets, feedback)


query("v08_review_priority", """, f AS (SELECT c_mktsegment AS issue, CASE WHEN language <> 'P' THEN c_nationkey END AS guard, (language <> 'F')::INT AS e FROM works JOIN customer ON c_custkey = source_id),
k AS (SELECT source_id, count(*) AS k FROM works GROUP BY 1),
t AS (SELECT c_custkey AS target_id, c_mktsegment AS issue, c_nationkey AS guard, CASE WHEN c_acctbal < 0 THEN 20.0 WHEN c_acctbal < 2000 THEN 8.0 WHEN c_acctbal < 5000 THEN 3.0 ELSE 1.0 END AS harm, coalesce(k, 0) AS d FROM customer LEFT JOIN k ON source_id = c_custkey),
x AS (SELECT issue, guard, count(*) AS n, sum(e) AS e FROM f WHERE guard IS NOT NULL GROUP BY ALL), b AS (SELECT issue, count(*) AS n, sum(e) AS e FROM f WHERE guard IS NULL GROUP BY ALL),
p AS (SELECT t.*, coalesce(x.n, 0) + coalesce(b.n, 0) AS examples, CAST(coalesce(x.e, 0) + coalesce(b.e, 0) AS BIGINT) AS errors FROM t LEFT JOIN x ON x.issue = t.issue AND x.guard = t.guard LEFT JOIN b ON b.issue = t.issue),
q AS (SELECT *, (1.0 + errors)::DOUBLE AS al, (1.0 + examples - errors)::DOUBLE AS be FROM p),
r AS (SELECT *, al / (al + be) * harm * (1 + ln(1 + d)) + sqrt(al * be / ((al + be) * (al + be) * (al + be + 1))) - 30.0 * 0.03 AS priority FROM q)
SELECT target_id, examples, errors, al / (al + be) AS error_probability, priority, harm = 20.0 AS mandatory, harm = 20.0 OR priority >= 1.0 AS review, 30.0::DOUBLE AS seconds FROM r""")(_priority)
