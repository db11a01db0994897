"""Selections, ablations and review priorities against brute force and on edge cases."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.operators import ablation as B
from scholium.operators import selection as S
from scholium.operators.graph import Graph

EDGE = "source long, target long, weight long, association_strength double"


def _random_edges(seed, nodes=24, share=0.25):
    r = random.Random(seed)
    return [(a, b, r.randint(1, 4), r.choice([0.1, 0.2, 0.5])) for a, b in combinations(range(nodes), 2) if r.random() < share]


@pytest.mark.parametrize("seed", range(3))
def test_display_selection_by_brute_force(spark, seed):
    edges = _random_edges(seed)
    degree = {v: sum(w for a, b, w, _ in edges if v in (a, b)) for v in range(24)}
    nodes = spark.createDataFrame([(v, v % 9, degree[v]) for v in degree], "node long, occurrences long, weighted_degree long")
    got = {(r["source"], r["target"]): (r["strong"], r["backbone"]) for r in S.display_selection(nodes, spark.createDataFrame(edges, EDGE), 12).collect()}
    shown = sorted(degree, key=lambda v: (-round(degree[v] + (v % 9) ** 0.5 / 4, 9), v))[:12]
    inner = sorted((e for e in edges if e[0] in shown and e[1] in shown), key=lambda e: (-round(e[3] * np.log1p(e[2]), 12), e[0], e[1]))
    strong = {e[:2] for e in inner[: max(24, min(36, 280))]}
    part, forest = {v: {v} for v in shown}, set()
    for a, b, *_ in inner:
        if part[a] is not part[b]:
            forest.add((a, b))
            part[a] |= part[b]
            for v in part[b]:
                part[v] = part[a]
    assert got == {e: (e in strong, e in forest) for e in strong | forest}


def test_display_selection_of_nothing(spark):
    nodes = spark.createDataFrame([(1, None, None), (2, 4, 1)], "node long, occurrences long, weighted_degree long")
    assert S.display_selection(nodes, spark.createDataFrame([], EDGE), 5).count() == 0
    assert S.display_selection(nodes.limit(0), spark.createDataFrame([(1, 2, 1, 0.5)], EDGE), 5).count() == 0
    assert S.display_selection(nodes, spark.createDataFrame([(1, 2, None, None)], EDGE), 5).first()["backbone"]


def test_merge_small():
    g = Graph([(1, 2, 5), (2, 3, 5), (1, 3, 5), (4, 5, 5), (5, 6, 5), (4, 6, 5), (3, 7, 2), (4, 7, 1), (8, 9, 1), (3, 4, 1)])
    label = {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 8: 2, 9: 2, 7: 3}
    got = S.merge_small(g, label, 3)
    assert got[7] == got[1] == 1 and got[4] == got[5] == 2 and got[8] == got[9] == 3  # without links it stays alone
    assert set(S.merge_small(g, label, 99).values()) == {1, 2, 3, 4}  # all small: all stay
    assert S.merge_small(g, label, 1) == S.merge_small(g, label, 0)
    tie = Graph([(1, 2, 1), (3, 4, 1), (4, 5, 1), (2, 9, 1), (3, 9, 1)])
    assert (m := S.merge_small(tie, {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 9: 2}, 2))[9] == m[1]  # ties: the smaller one
    assert S.merge_small(Graph([]), {}, 3) == {}


def test_anchored_records(spark):
    g = Graph([(1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 5, 9), (5, 4, 9), (6, 7, 2)])
    names, rank = {v: f"N{v}" for v in range(1, 9)}, {v: v for v in range(1, 9)}
    anchors, nodes, edges = S.anchored(g, names, rank, "How is 'n3' linked to 'N1' at all?", 5)
    assert anchors == [3, 1] and set(nodes) == {1, 2, 3} and set(edges) == {(1, 2), (2, 3)}
    anchors, nodes, edges = S.anchored(g, names, rank, "'N3' 'N1'", 9)
    assert (1, 5) in edges and len(nodes) + len(edges) <= 9
    anchors, nodes, _ = S.anchored(g, names, rank, "what is central? N3", 4, salient=2)
    assert anchors == [] and {8, 7} <= set(nodes)
    nodes = spark.createDataFrame([("g", v, n, rank[v]) for v, n in names.items()] + [("g", 99, None, 0)], "graph string, node long, label string, importance long")
    edges = spark.createDataFrame([("g", 1, 2, 1), ("g", 2, 3, 1)], "graph string, source long, target long, weight long")
    rows = S.anchored_records(edges, nodes, "'N1' 'N3'", 5, "long").orderBy("position").collect()
    assert [r["record"] for r in rows] == ["edge", "edge", "node", "node", "node"] and {(r["source"], r["target"]) for r in rows[:2]} == {(1, 2), (2, 3)}


ITEM = "item_id long, answerable boolean, answer string, statement string, evidence array<string>"
SAID = "item_id long, abstain boolean, answer string, statement string, evidence array<string>"


def test_scores(spark):
    items = spark.createDataFrame([(1, True, "a", "It is A", ["x", "y"]), (2, True, "b", "It is B.", ["x"]), (3, False, None, None, None), (4, False, None, None, []), (5, True, "c", None, ["z"])], ITEM)
    given = spark.createDataFrame([(1, False, "a", "it  IS a ;", ["x", "x"]), (2, True, None, None, None), (3, True, None, "no", []), (4, False, "q", "a claim", ["w"]), (9, False, "a", None, None)], SAID)
    rows = {r["item_id"]: r for r in B.score_predictions(items, given).collect()}
    assert [rows[k]["correct"] for k in range(1, 6)] == [True, False, True, False, False]
    assert rows[1]["statement_supported"] and rows[4]["statement_supported"] is False and rows[3]["statement_supported"] is None and not rows[5]["schema_valid"]
    assert (rows[1]["evidence_tp"], rows[1]["evidence_fn"], rows[4]["evidence_fp"], rows[1]["evidence_valid"], rows[5]["evidence_valid"], rows[2]["evidence_valid"]) == (1, 1, 1, True, False, None)
    s = B.prediction_summary(B.score_predictions(items, given)).first()
    assert (s["items"], s["accuracy"], s["abstention_precision"], s["abstention_recall"], s["unsupported_claim_rate"]) == (5, 0.4, 0.5, 0.5, 0.5)
    assert B.prediction_summary(B.score_predictions(items.limit(0), given)).first()["items"] == 0


def test_paired_ablation_needs_pairs(spark):
    a = spark.createDataFrame([(1, True), (2, False)], "item_id long, correct boolean")
    assert B.paired_ablation(a, a.withColumn("correct", F.lit(False))).first()["first_only"] == 1
    with pytest.raises(Exception, match="unpaired item"):
        B.paired_ablation(a, a.filter("item_id = 1")).collect()


def test_ablation_interval_is_that_of_resampled_items(spark):
    r = random.Random(5)
    rows = [("s" if k < 150 else "t", r.random() < 0.7, r.random() < 0.4) for k in range(220)]
    got = B.ablation_interval(spark.createDataFrame(rows, "s string, a boolean, b boolean"), "s", "a", "b", 4000).first()
    gain = np.array([int(a) - int(b) for _, a, b in rows])
    draw = np.random.default_rng(1)
    free = np.quantile([gain[draw.integers(0, 220, 220)].mean() for _ in range(4000)], [0.025, 0.975])
    held = np.quantile([(gain[draw.integers(0, 150, 150)].sum() + gain[150 + draw.integers(0, 70, 70)].sum()) / 220 for _ in range(4000)], [0.025, 0.975])
    assert got["difference"] == pytest.approx(gain.mean())
    assert np.allclose([got["free_low"], got["free_high"]], free, atol=0.015) and np.allclose([got["stratified_low"], got["stratified_high"]], held, atol=0.015)
    with pytest.raises(ValueError):
        B.ablation_interval(spark.createDataFrame([], "s string, a boolean, b boolean"), "s", "a", "b")


def test_topic_bootstrap_without_topics(spark):
    rows = spark.createDataFrame([(None, 1, True), ("t", 2, False)], "t string, x long, bad boolean")
    assert B.topic_bootstrap(rows, "t", "x", F.col("bad")).first()["row_low"] is None
    one = B.topic_bootstrap(rows.filter("t IS NOT NULL"), "t", "x", F.col("bad"), 40).first()
    assert (one["row_low"], one["row_high"], one["article_high"]) == (0.0, 0.0, 0.0)


def test_swap_keeps_totals(spark):
    t = spark.createDataFrame([(k, y, 10 * k + y % 7) for k in "12" for y in (1990, 1992, 1995, 1996, 1999, 2000, 2004) for k in [int(k)]], "k long, year long, works long")
    new = B.swap_windows(t)
    assert t.groupBy("k").agg(F.sum("works")).exceptAll(new.groupBy("k").agg(F.sum("works"))).count() == 0
    assert {(r["works"], r["year"]) for r in new.filter("k = 1").collect()} == {(10 + y % 7, z) for y, z in zip((1990, 1992, 1995, 1996, 1999, 2000, 2004), (1999, 2000, 2004, 1996, 1990, 1992, 1995), strict=True)}
    with pytest.raises(Exception, match="too few years"):
        B.swap_windows(t.filter("year < 1999")).collect()


def test_credit_and_priority(spark):
    kind = "feedback_id long, target_type string, action string, replacement string"
    for bad in [(1, "claim", "rewrite", None), (2, "title", "accept", None), (3, "claim", "shrug", None), (4, None, None, None)]:
        with pytest.raises(Exception, match="teaches nothing"):
            B.feedback_credit(spark.createDataFrame([bad], kind)).collect()
    targets = spark.createDataFrame([(1, "i", "g", "critical", 0, 1e6), (2, "i", None, "low", 0, 0.0), (3, "new", "g", "high", 5, 30.0)], "target_id long, issue string, guard string, severity string, descendants long, seconds double")
    feedback = spark.createDataFrame([("i", "g", "accept"), ("i", "g", "reject_claim"), ("i", None, "reject_claim")], "issue string, guard string, action string")
    got = {r["target_id"]: r for r in B.review_priority(targets, feedback).collect()}
    assert got[1]["review"] and got[1]["priority"] < 0 and (got[1]["examples"], got[1]["errors"]) == (3, 2)
    assert (got[2]["examples"], got[2]["error_probability"]) == (1, 2 / 3) and got[3]["error_probability"] == 0.5
    assert B.review_priority(targets, feedback.limit(0)).count() == 3
