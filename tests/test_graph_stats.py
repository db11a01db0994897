import pytest
from pyspark.sql import functions as F

from scholium.operators import graph as G
from scholium.operators import networks as N
from scholium.operators import programs as P
from scholium.operators import retrieval as R
from scholium.operators import review as V
from scholium.operators import stats as X

TOY = [("a", "b", 3), ("b", "c", 3), ("a", "c", 1), ("c", "d", 1), ("d", "e", 3), ("e", "f", 3), ("d", "f", 1)]


def test_toy_graph(spark):
    g = G.Graph(TOY)
    assert [len(p) for p in g.components()] == [6] and [len(p) for p in g.components({"c"})] == [3, 2]
    node, edge = g.betweenness()
    assert node["c"] == node["d"] == 6.0 and edge[("c", "d")] == 9.0
    label = g.louvain()
    assert len(set(label.values())) == 2 and label["a"] == label["c"] != label["d"]
    assert g.modularity(label) > 0.3
    assert len(g.spanning_forest()) == 5 and sum(w for *_, w in g.spanning_forest()) == 13
    assert P.bridge(g, label)["edge"] == ["c", "d"] and P.bridge(g, label)["splits"]
    assert P.hub_removal(g)["hub"] == "b"
    assert g.shortest_path("a", "f") == ["a", "c", "d", "f"]
    edges = spark.createDataFrame(TOY, "source string, target string, weight long")
    assert N.perturb_edges(edges, 4).count() == 0 and N.perturb_edges(edges, 0, 0.5).count() == 4
    parts = G.connected_components(spark, edges.filter("source <> 'c'"), spark.createDataFrame([("z",)], "node string"))
    assert {r["component"] for r in parts.collect()} == {"a", "d", "z"}
    assert len(P.VARIANTS) == 18
    assert G.community_quotas([50, 30, 5], 10) == [6, 3, 1] and sum(G.community_quotas([1, 1, 1], 10)) == 3
    assert P.compare_partitions(label, label) == {"ari": 1.0, "jaccard": 1.0}


def test_pair_mass_and_permutation(spark):
    rows = [(w, i) for w in range(20) for i in range(w % 5 + 1)]
    m = spark.createDataFrame(rows, "w long, i long")
    mass = sum(n * (n - 1) // 2 for n in (w % 5 + 1 for w in range(20)))
    pairs = N.group_pairs(m, "w", "i")
    assert pairs.agg(F.sum("weight")).first()[0] == mass
    again = N.group_pairs(m.orderBy(F.desc("i")).unionAll(m), "w", "i")
    assert pairs.exceptAll(again).count() == again.exceptAll(pairs).count() == 0
    assert N.group_pairs(spark.createDataFrame([(1, 1), (2, None)], "w long, i long"), "w", "i").count() == 0


def test_published_values(spark):
    assert X.exact_mcnemar(47, 0) == pytest.approx(1.42109e-14, rel=1e-4)
    assert X.exact_mcnemar(15, 0) == pytest.approx(6.10352e-05, rel=1e-4)
    p = spark.createDataFrame([("a", 0.03125), ("b", 0.5), ("c", 1.0)], "k string, p double")
    assert [r["adjusted"] for r in X.holm(p, "k", "p").orderBy("k").collect()] == [0.09375, 1.0, 1.0]
    e = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    r = X.sign_flip_test(e, "x").first()
    assert (r["p_two_sided"], r["p_greater"], r["patterns"]) == (0.25, 0.125, 8)
    b = X.cluster_bootstrap(spark.createDataFrame([(2.0,)] * 5, "x double"), "x", 100).first()
    assert (b["low"], b["estimate"], b["high"]) == (2.0, 2.0, 2.0)
    with pytest.raises(ValueError):
        X.sign_flip_test(spark.createDataFrame([], "x double"), "x")


def test_sign_flip_of_more_effects(spark):
    """Thirty effects against the exact distribution of integer sums; the 25 nations of y02."""
    effects = [1, 2, 3, 5, 8, -4] * 5
    ways = {0: 1}
    for e in effects:
        new = {}
        for s, n in ways.items():
            for t in (s + e, s - e):
                new[t] = new.get(t, 0) + n
        ways = new
    r = X.sign_flip_test(spark.createDataFrame([(float(e),) for e in effects], "x double"), "x").first()
    total = sum(effects)
    assert r["patterns"] == 1 << 30
    assert r["p_greater"] == sum(n for s, n in ways.items() if s >= total) / (1 << 30)
    assert r["p_two_sided"] == sum(n for s, n in ways.items() if abs(s) >= total) / (1 << 30)
    import __spark_entry__ as entry

    got = entry.queries()["y02_equivalence"](spark, "/root/testdata/sf0.01").first()
    assert 0 < got["p_value"] == max(got["p_low"], got["p_high"]) <= 1


def test_review(spark):
    t = spark.createDataFrame([("g", "a", 5.0, 4.0, False), ("g", "b", 4.0, 4.0, False), ("g", "c", 3.0, 1.0, False), ("g", "d", 0.0, 9.0, True)], "g string, target_id string, priority double, cost double, mandatory boolean")
    assert [r["target_id"] for r in V.greedy_budget(t, "g", 14.0).orderBy("order").collect()] == ["d", "a", "c"]
    c = spark.createDataFrame([("x", 1, 0.5, 1.0, 1.0, 1, []), ("x", 2, 0.4, 1.0, 1.0, 0, [1]), ("x", 3, 0.45, 1.0, 1.0, 0, [])], "article string, claim_id long, risk double, harm double, cost double, truth int, depends array<long>")
    steps = V.sequential_replay(c, "article", 2.0).orderBy("step").collect()
    assert [r["claim_id"] for r in steps] == [1, 2] and steps[1]["risk_then"] == pytest.approx(0.7)
    cases = spark.createDataFrame([(1, "d", 0.5, 10.0), (2, "d", 0.01, 10.0)], "case_id long, domain string, risk double, harm double")
    people = spark.createDataFrame([("r1", "d", 0.9, 1.0), ("r2", "d", 0.8, 1.0)], "reviewer string, domain string, accuracy double, cost double")
    assert [(r["option"], r["reviewer"]) for r in V.route(cases, people).orderBy("case_id").collect()] == [("single", "r1"), ("auto", None)]


def test_retrieval_edges(spark):
    d = spark.createDataFrame([(1, ""), (2, "word"), (3, None), (4, "word other word")], "id long, t string")
    assert {r["id"] for r in R.derived_keywords(d, "id", "t").collect()} == {2, 4}
    assert {r["id"] for r in R.bm25(d, "id", "t", ["word"]).collect()} == {2, 4}
    s = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "g array<string>, o array<string>")
    assert [round(r["f1"], 3) for r in R.set_scores(s, "g", "o").collect()] == [0.5, 1.0]
    ranked = spark.createDataFrame([("q", 1, 3), ("q", 2, 0), ("q", 3, 1)], "q string, rank int, grade int")
    r = R.ranking_metrics(ranked, "q", "grade", 2).first()
    assert r["recall"] == 0.5 and 0 < r["ndcg"] < 1 and r["off_topic"] == 0.5
    v = spark.createDataFrame([(1, "one two\nthree four five", 3)], "k long, t string, n int").select(R.cut_to_budget("t", "n").alias("x")).first()["x"]
    assert v == "one two\nthree"


def test_whole_clusters_enter_the_statistics(spark, sf):
    import __spark_entry__ as entry

    read = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("supplier", "nation")}
    held = read["supplier"].join(read["nation"], F.col("n_nationkey") == F.col("s_nationkey"))
    got = entry.queries()["x01_cluster_bootstrap"](spark, sf).first()
    assert got["clusters"] == held.select("s_nationkey").distinct().count()
    got = entry.queries()["x03_sign_flip_regions"](spark, sf).first()
    assert got["patterns"] == 2 ** held.select("n_regionkey").distinct().count()


def test_title_key_reads_the_whole_text(spark, tmp_path):
    import __spark_entry__ as entry

    same = "the same beginning " * 5
    rows = [(1, same + "One"), (2, same + "Two!"), (3, None)]
    spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["title_key"] for r in entry.queries()["f04_title_key_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: same + "one", 2: same + "two", 3: None}


def test_graph_queries_use_the_references_pool(spark, sf):
    import __spark_entry__ as entry

    from scholium.plans.corpus import Corpus

    items = N.candidates(Corpus(spark, sf).memberships, "work_id", "item", 500).count()
    assert 60 < entry.queries()["g12_communities"](spark, sf).count() <= items
