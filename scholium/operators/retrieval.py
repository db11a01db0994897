"""Term statistics, BM25, TF-IDF, rank fusion, vector search and ranking metrics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scholium.functions.text import word_tokens

# The terms that derived keywords never use.
STOPWORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could "
    "did do does doing during each few for from further had has have having he her here hers herself him himself his how i if in into is it "
    "its itself just may me might more most my myself no nor not now of off on once only or other our ours ourselves out over own same she "
    "should so some such than that the their theirs them themselves then there these they this those through to too under until up very was "
    "we were what when where which while who whom why will with would you your yours yourself yourselves "
    "aim aimed article background based conclusion conclusions data findings included including method methods objective paper purpose "
    "research result results review study studies using"
).split()


def simple_tokens(text: Column) -> Column:
    """Lower-cased [a-z0-9]+ runs of three or more characters that are neither stopwords nor numbers."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS) & ~t.rlike("^[0-9]+$"))


def with_bigrams(tokens: Column) -> Column:
    """Tokens followed by their adjacent pairs."""
    pairs = F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t, i: F.concat(t, F.lit(" "), F.get(tokens, i + 1)))
    return F.concat(tokens, pairs)


def keyword_terms(text: str) -> Column:
    """Terms of the column ``text``: valid tokens and pairs of neighbours that are both valid, of 3 to 80 characters.

    Tokens are lower-cased [a-z0-9]+ runs; valid ones have three or more characters and are neither stopwords nor
    numbers. Pairs are neighbours in the text, so no pair bridges a token that is left out.
    """
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)

    valid = f"length(t) >= 3 AND t NOT IN ({stop}) AND NOT t RLIKE '^[0-9]+$'"
    words = f"transform(split(lower({text}), '[^a-z0-9]+'), t -> CASE WHEN {valid} THEN t END)"  # null where left out
    pairs = "zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, greatest(size(words) - 1, 0)), (t, u) -> concat(t, ' ', u))"
    # The array of one binds the words to a name: named in a lambda, an expression runs for every element.
    terms = f"get(transform(array({words}), words -> concat(words, {pairs})), 0)"
    return F.expr(f"filter({terms}, t -> length(t) BETWEEN 3 AND 80)")


def derived_keywords(docs: DataFrame, key: str, text: str, top: int = 5, vocabulary: int = 5000) -> DataFrame:
    """The ``top`` terms of each document by (1 + ln tf)(ln((N + 1) / (df + 1)) + 1); ``key`` is unique.

    Terms need a document frequency from 3 (2 below 100 documents) to max(that, floor(0.6 N)); of those the
    ``vocabulary`` most frequent count. Document frequencies come first, combined beside the scan; only terms of
    the vocabulary, which is bounded and broadcast, are counted by document.
    """
    terms = docs.select(key, keyword_terms(text).alias("terms"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    # explode would add a filter on the array's size, and with it the whole expression once more.
    df = terms.select(F.explode_outer(F.array_distinct("terms")).alias("term")).filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))
    least = F.when(F.col("n") < 100, 2).otherwise(3)
    vocab = df.filter((F.col("df") >= least) & (F.col("df") <= F.greatest(least, F.floor(F.col("n") * 0.6)))).orderBy(F.desc("df"), "term").limit(vocabulary)
    score = F.round((1 + F.log("tf")) * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1), 6)
    held = terms.select(key, F.explode_outer("terms").alias("term")).join(F.broadcast(vocab), "term")
    scored = held.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("df").alias("df"), F.first("n").alias("n")).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select(key, "term", "score")


def derived_where_sparse(docs: DataFrame, key: str, text: str, keywords: DataFrame, least: float = 0.5) -> DataFrame:
    """:func:`derived_keywords` where fewer than ``least`` of the documents have a keyword of their own, else no rows."""
    covered = docs.join(keywords.select(key).distinct(), key, "left_semi").count()
    found = derived_keywords(docs, key, text)
    return found if covered < least * docs.count() else found.filter("false")


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that hold a query term; idf = ln(1 + (N - df + 0.5) / (df + 0.5)). ``key`` is unique.

    A first pass counts documents, lengths and each term's documents in one row, a second scores; no rows are shuffled.
    """
    terms = sorted(set(query))
    found = F.transform(F.array(word_tokens(F.coalesce(text, F.lit("")))), lambda words: F.struct(F.size(words).alias("length"), F.filter(words, lambda t: t.isin(terms)).alias("hits")))
    # Named twice below, so that the scan's tokens stay a column of their own.
    rows = docs.select(key, F.get(found, F.lit(0)).alias("found")).select(key, F.col("found.length").alias("length"), F.col("found.hits").alias("hits"))
    held = [F.count_if(F.array_contains("hits", t)).cast("double") for t in terms]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), F.array(*held).alias("df"))
    n, norm = F.col("n"), k1 * (1 - b + b * F.col("length") / F.col("mean"))

    def part(term: str, k: int):
        tf, df = F.size(F.filter("hits", lambda t: t == term)), F.get("df", F.lit(k))
        return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + norm)

    score = reduce(lambda x, y: x + y, [part(t, k) for k, t in enumerate(terms)], F.lit(0.0))
    return rows.filter(F.size("hits") > 0).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))


def top_ranked(scores: DataFrame, key: str, k: int, digits: int = 9) -> DataFrame:
    """The k best with rank, ties by key; scores rounded first so that summation order cannot matter."""
    top = scores.select(key, F.round("score", digits).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


def tfidf_cosine(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Cosine of sublinear TF-IDF vectors over 1- and 2-grams with a query text (smoothed idf)."""
    tokens = docs.select(key, word_tokens(F.coalesce(text, F.lit(""))).alias("tokens"))
    tf = tokens.select(key, F.explode(with_bigrams(F.col("tokens"))).alias("term")).groupBy(key, "term").agg((1 + F.log(F.count(F.lit(1)))).alias("w"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(idf, "term").select(key, "term", (F.col("w") * F.col("idf")).alias("x"))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    asked = docs.sparkSession.range(1).select(F.explode(with_bigrams(word_tokens(F.lit(query)))).alias("term")).groupBy("term").agg((1 + F.log(F.count(F.lit(1)))).alias("w"))
    asked = asked.join(idf, "term").select("term", (F.col("w") * F.col("idf")).alias("q"))
    length = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    dots = weighted.join(F.broadcast(asked), "term").groupBy(key).agg(F.sum(F.col("x") * F.col("q")).alias("dot"))
    return dots.join(norms, key).crossJoin(F.broadcast(length)).select(key, (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score"))


def reciprocal_rank_fusion(rankings: list[DataFrame], key: str, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over rankings with (key, rank)."""
    rows = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(key, "rank"))
    return rows.groupBy(key).agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("score"))


def cosine_top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k vectors of largest cosine with a stated query vector; one scan, per-partition top k."""
    q = F.array(*[F.lit(float(x)) for x in query])

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)

    norm = sum(x * x for x in query) ** 0.5 or 1.0
    v = F.col(vector)
    cosine = F.round(F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * norm), 6)
    return vectors.select(key, cosine.alias("score")).orderBy(F.col("score").desc_nulls_last(), key).limit(k)


def overlap_retrieval(facts: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """Facts by the number of distinct query words that they contain."""
    words = sorted({w for w in query.lower().split() if len(w) >= 2})
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = sum((F.contains(lowered, F.lit(w)).cast("int") for w in words), F.lit(0))
    return facts.select(key, hits.alias("overlap")).filter("overlap > 0").orderBy(F.desc("overlap"), key).limit(k)


def ranking_metrics(ranked: DataFrame, query: str, grade: str, k: int = 10, gains: tuple[float, ...] = (0.0, 0.5, 1.0, 3.0)) -> DataFrame:
    """nDCG@k, recall@k of positive grades and off-topic rate by query; ``ranked`` has (query, rank, grade 0..3)."""
    gain = F.element_at(F.array(*[F.lit(g) for g in gains]), F.col(grade) + 1)
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(grade), "rank"))
    rows = ranked.withColumn("gain", gain).withColumn("ideal", ideal)
    inside, best = F.col("rank") <= k, F.col("ideal") <= k
    out = rows.groupBy(query).agg(
        F.sum(F.when(inside, F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(best, F.col("gain") / F.log2(F.col("ideal") + 1)).otherwise(0.0)).alias("best"),
        F.count_if(inside & (F.col(grade) > 0)).alias("found"),
        F.count_if(F.col(grade) > 0).alias("relevant"),
        F.count_if(inside & (F.col(grade) == 0)).alias("off"),
        F.count_if(inside).alias("shown"),
    )
    return out.select(query, F.coalesce(F.try_divide("dcg", "best"), F.lit(0.0)).alias("ndcg"), F.coalesce(F.try_divide("found", "relevant"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide("off", "shown"), F.lit(0.0)).alias("off_topic"))


def set_scores(rows: DataFrame, gold: str, observed: str) -> DataFrame:
    """Precision, recall and F1 of two id arrays per row."""
    both = F.size(F.array_intersect(gold, observed))
    g, o = F.size(F.array_distinct(gold)), F.size(F.array_distinct(observed))
    p, r = F.when(o > 0, both / o).otherwise((g == 0).cast("double")), F.when(g > 0, both / g).otherwise(1.0)
    return rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def merge_top_k(rankings: DataFrame, batch: DataFrame, key: str, k: int) -> DataFrame:
    """Top k of an earlier top k and a new batch."""
    return rankings.unionByName(batch).orderBy(F.desc("score"), key).limit(k)


@F.pandas_udf(StringType())
def cut_to_budget(text: pd.Series, budget: pd.Series) -> pd.Series:
    """The longest prefix in whole lines, then in words of the next line, of at most ``budget`` words."""
    def one(t, n):
        if t is None:
            return None
        out, left = [], int(n)
        for line in t.split("\n"):
            words = line.split()
            if len(words) > left:
                if left:
                    out.append(" ".join(words[:left]))
                break
            out.append(line)
            left -= len(words)
        return "\n".join(out)

    return pd.Series([one(t, n) for t, n in zip(text, budget, strict=True)])


def latent_vectors(docs: DataFrame, key: str, text: str, dimensions: int = 48, vocabulary: int = 4096) -> DataFrame:
    """(key, vector): TF-IDF over a bounded vocabulary projected on its leading right singular vectors.

    Signs and rotations are arbitrary; cosines between documents are not.
    """
    from pyspark.ml.feature import IDF, CountVectorizer
    from pyspark.ml.functions import vector_to_array
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    rows = docs.select(key, simple_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    counted = CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=vocabulary, minDF=2.0).fit(rows).transform(rows)
    weighted = IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)
    matrix = RowMatrix(weighted.select("tfidf").rdd.map(lambda r: Vectors.fromML(r[0])))
    k = min(dimensions, matrix.numCols() - 1)
    # The Gram matrix is bounded by the vocabulary and takes one pass, where an iterative solver takes one for each step.
    _, vectors = np.linalg.eigh(matrix.computeGramianMatrix().toArray())
    v = vectors[:, ::-1][:, :k]  # vocabulary x k, largest first
    basis = F.array(*[F.array(*[F.lit(float(x)) for x in v[:, j]]) for j in range(k)]) if v.size <= 2000 else None
    if basis is None:
        table = docs.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "term int, axis array<double>")
        flat = weighted.select(key, F.posexplode(vector_to_array("tfidf")).alias("term", "x")).filter("x <> 0")
        parts = flat.join(F.broadcast(table), "term").select(key, F.posexplode(F.transform("axis", lambda a: a * F.col("x"))).alias("axis", "y"))
        summed = parts.groupBy(key, "axis").agg(F.sum("y").alias("y")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "y"))), lambda s: s["y"]).alias("vector"))
        return docs.select(key).join(summed, key, "left")
    x = vector_to_array("tfidf")
    return weighted.select(key, F.transform(basis, lambda b: F.aggregate(F.zip_with(x, b, lambda p, q: p * q), F.lit(0.0), lambda a, y: a + y)).alias("vector"))
