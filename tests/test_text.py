import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scholium.functions import text as T
from scholium.operators import diagnostics as D
from scholium.operators import retrieval as R


def one(spark, expression, *values):
    kinds = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([tuple(values)], kinds).select(expression(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_clean_text(spark):
    assert one(spark, T.clean_text, "<b>A &amp;</b>\n ﬁne ") == "A & fine"
    assert one(spark, T.clean_text, "<p> </p>") is None
    assert one(spark, T.clean_text, None) is None


def test_identifiers(spark):
    assert one(spark, T.normalize_doi, "https://doi.org/10.1000/ABC.;") == "10.1000/abc"
    assert one(spark, T.normalize_doi, "doi: 11.1/x") is None
    assert one(spark, T.normalize_orcid, "https://orcid.org/0000-0001-2345-678X") == "0000-0001-2345-678X"
    assert one(spark, T.normalize_orcid, "0000") is None
    import hashlib

    assert one(spark, lambda a, b: T.stable_id("w", a, b), " Straße ", None) == "w:" + hashlib.sha1("strasse\x1f".encode()).hexdigest()[:20]


def test_labels(spark):
    assert one(spark, T.normalize_title, "Deep-Learning: <i>A</i> review!") == "deep-learning a review"
    assert one(spark, T.normalize_affiliation, "Dept. of X, University of Y, Z City") == "University of Y"
    assert one(spark, T.normalize_keyword, "Humans") is None
    assert one(spark, T.normalize_keyword, "large language model") == "Large language models"
    assert one(spark, T.normalize_keyword, "DNA") == "DNA"
    assert one(spark, T.normalize_keyword, "gene_editing") == "Gene editing"
    assert one(spark, lambda a: T.normalize_document_type(F.array(a, F.lit("Journal Article"))), "Systematic Review") == "Systematic review"


def test_small_parsers(spark):
    assert one(spark, T.year_of, "May 2019; 2020") == 2019
    assert one(spark, T.split_list, "a; b|;c") == ["a", "b", "c"]
    assert one(spark, T.evidence_ids, "E001-E003, E010 and E002") == ["E001", "E002", "E003", "E010"]
    assert one(spark, T.normalize_statement, "A – B.  ") == "a - b"
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(T.date_parts(F.lit(None).cast("array<array<int>>"), F.array(F.array(F.lit(2025), F.lit(2)))), ("y", "d"))]).first()
    assert (row["y"], row["d"]) == (2025, "2025-02")
    got = spark.range(1).select(T.inverted_abstract(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2)))).alias("x")).first()["x"]
    assert got == "a b a"


def test_bounds(spark):
    assert abs(T.clopper_pearson_lower(92, 92) - 0.968) < 5e-4
    assert abs(T.clopper_pearson_lower(16, 16) - 0.829) < 5e-4
    rows = spark.createDataFrame([("openalex-author:None",), ("x/",), ("ok:1",), (None,)], "i string").select(T.is_placeholder(F.col("i")).alias("p")).collect()
    assert [r["p"] for r in rows] == [True, True, False, True]


def test_tfidf_cosine(spark):
    """Against the formula: sublinear weights over words and pairs, smoothed idf, cosine."""
    texts = {1: "red fox runs", 2: "red red dog", 3: "the blue sky", 4: None, 5: "fox"}

    def grams(t):
        w = (t or "").split()
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    tf = {k: grams(t) for k, t in texts.items()}
    df = Counter(g for c in tf.values() for g in c)
    weight = {k: {g: (1 + math.log(n)) * (math.log(6 / (1 + df[g])) + 1) for g, n in c.items()} for k, c in tf.items()}
    asked = {g: (1 + math.log(n)) * (math.log(6 / (1 + df[g])) + 1) for g, n in grams("red fox").items() if g in df}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    expected = {k: sum(x * asked[g] for g, x in v.items() if g in asked) / norm(v) / norm(asked) for k, v in weight.items() if set(v) & set(asked)}
    docs = spark.createDataFrame(list(texts.items()), "k int, t string")
    got = {r["k"]: r["score"] for r in R.tfidf_cosine(docs, "k", "t", "red fox").collect()}
    assert got == pytest.approx(expected)


def test_latent_vectors(spark):
    """Equal texts have equal vectors, texts without a common word orthogonal ones; every row has one."""
    texts = ["apple pear plum", "apple pear plum", "engine wheel brake", "engine wheel brake", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r["vector"] for r in R.latent_vectors(docs, "k", "t", 2, 16).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b]))
    assert sorted(got) == [0, 1, 2, 3, 4] and got[0] == pytest.approx(got[1])
    assert dot(0, 0) > 0.1 < dot(2, 2) and dot(0, 2) == pytest.approx(0, abs=1e-9) and not any(got[4])


def test_near_duplicate_paragraphs(spark):
    """Against all pairs of sets; repeated rows of one paragraph are one set, and no shingle is shuffled."""
    rng = random.Random(3)
    base = [[f"w{rng.randrange(200)}" for _ in range(n)] for n in (3, 12, 40, 40)]
    rows = [(k % 3, k, " ".join(x if rng.random() > 0.02 else "Y" for x in rng.choice(base))) for k in range(90)] + [(None, 1, "a b"), (None, 2, "a b"), (0, 0, "more words")]
    sets = {}
    for g, k, t in rows:
        w = t.lower().split()
        if g is not None:
            sets.setdefault((g, k), set()).update(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    expected = {(g, a, b): round(len(x & y) / len(x | y), 6) for (g, a), x in sets.items() for (h, b), y in sets.items() if g == h and a < b and len(x & y) / len(x | y) >= 0.8}
    found = D.near_duplicate_paragraphs(spark.createDataFrame(rows, "g int, k int, t string"), "g", "k", "t")
    got = [((r["g"], r["left"], r["right"]), r["similarity"]) for r in found.collect()]
    assert dict(got) == pytest.approx(expected) and len(got) == len(expected) > 100
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
