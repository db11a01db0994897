"""Evaluation statistics as DataFrame programs: bootstraps, exact tests, agreement, metrics.

Tests enumerate or resample small tables of effects (topics, clusters), so replicates are
rows of ``spark.range`` joined with broadcast effects. Random draws come from hashes of
(seed, replicate, slot), which any engine can repeat.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Halves of so many have 2^20 sums, 8 MB.
MOST_EFFECTS = 40


def uniform(*parts: Column) -> Column:
    """A hash-based number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)).cast("double") / (1 << 30)


def cluster_bootstrap(clusters: DataFrame, value: str, replicates: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Mean of cluster values with a percentile interval over resampled clusters (linear quantiles)."""
    effects = [float(r[0]) for r in clusters.select(F.col(value).cast("double")).filter(F.col(value).isNotNull()).orderBy(value).limit(100_001).collect()]
    if not effects or len(effects) > 100_000:
        raise ValueError("cluster_bootstrap takes 1 to 100000 cluster values; aggregate to clusters first")
    k = len(effects)
    spark = clusters.sparkSession
    values = F.array(*[F.lit(e) for e in effects]) if k <= 200 else None
    draws = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    pick = F.floor(uniform(F.lit(seed), F.col("replicate"), F.col("slot")) * k).cast("int")
    if values is not None:
        draws = draws.select("replicate", F.get(values, pick).alias("x"))
    else:
        table = spark.createDataFrame(list(enumerate(effects)), "pick int, x double")
        draws = draws.withColumn("pick", pick).join(F.broadcast(table), "pick").select("replicate", "x")
    means = draws.groupBy("replicate").agg(F.avg("x").alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high")).select(F.lit(sum(effects) / k).alias("estimate"), "low", "high", F.lit(k).alias("clusters"))


def _signed_sums(values: list[float]) -> np.ndarray:
    """The sums of all sign patterns, the one without a flip first."""
    sums = np.zeros(1)
    for e in values:
        sums = np.concatenate([sums + e, sums - e])
    return sums


def sign_flip_test(effects: DataFrame, value: str) -> DataFrame:
    """Exact sign-flip p-values of the mean over all 2^n sign patterns, one- and two-sided.

    A pattern's sum is one of the first half's plus one of the second half's, so sorted halves count all of them.
    """
    rows = [float(r[0]) for r in effects.select(F.col(value).cast("double")).filter(F.col(value).isNotNull()).limit(MOST_EFFECTS + 1).collect()]
    if not rows or len(rows) > MOST_EFFECTS:
        raise ValueError(f"sign_flip_test takes 1 to {MOST_EFFECTS} effects")
    rows.sort()
    left, right = _signed_sums(rows[::2]), _signed_sums(rows[1::2])
    observed = float(left[0] + right[0])
    right.sort()
    patterns, slack = 1 << len(rows), 1e-12 * max(1.0, sum(map(abs, rows)))

    def reaching(least: float) -> int:
        return patterns - int(np.searchsorted(right, least - left, "left").sum())

    beyond = abs(observed) - slack
    both = min(patterns, 2 * reaching(beyond)) if beyond > 0 else patterns  # a pattern and its reverse have opposite sums
    out = [F.lit(both / patterns).alias("p_two_sided"), F.lit(reaching(observed - slack) / patterns).alias("p_greater")]
    return effects.sparkSession.range(1).select(*out, F.lit(patterns).cast("long").alias("patterns"), F.lit(observed / len(rows)).alias("mean"))


def holm(p_values: DataFrame, key: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Holm-adjusted p-values: running maximum of p (m - rank + 1), at most 1."""
    family = Window.partitionBy(*(by or []))
    order = family.orderBy(p, key)
    raw = F.col(p) * (F.count(F.lit(1)).over(family) - F.row_number().over(order) + 1)
    rows = p_values.withColumn("__raw", raw)
    running = F.max("__raw").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("adjusted", F.least(F.lit(1.0), running)).drop("__raw")


def exact_mcnemar(left_only: int, right_only: int) -> float:
    """Two-sided exact binomial p-value of discordant pairs."""
    n, k = left_only + right_only, min(left_only, right_only)
    if n == 0:
        return 1.0
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
    return min(1.0, 2 * tail)


def mcnemar(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Discordant counts, exact p-value and matched odds ratio of paired successes; counts in one pass."""
    once = pairs.agg(F.count_if(F.col(left) & ~F.col(right)).alias("left_only"), F.count_if(~F.col(left) & F.col(right)).alias("right_only"), F.count(F.lit(1)).alias("n"))
    row = once.first()
    p = exact_mcnemar(row["left_only"], row["right_only"])
    ratio = F.when(F.col("right_only") == 0, F.when(F.col("left_only") == 0, F.lit(None)).otherwise(F.lit(float("inf")))).otherwise(F.col("left_only") / F.col("right_only"))
    return once.select("left_only", "right_only", "n", F.lit(p).alias("p_value"), ratio.cast("double").alias("odds_ratio"))


def cohen_kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa; 1 where both always give one label."""
    by = by or []
    cells = pairs.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agree"))
    rows = cells.groupBy(*by, F.col(a).alias("__l")).agg(F.sum("n").alias("ra"))
    columns = cells.groupBy(*by, F.col(b).alias("__l")).agg(F.sum("n").alias("rb"))
    chance = rows.join(columns, [*by, "__l"]).groupBy(*by).agg(F.sum(F.col("ra") * F.col("rb")).alias("ab"))
    joined = total.join(chance, by, "left") if by else total.crossJoin(chance)
    pe, po = F.coalesce("ab", F.lit(0)) / (F.col("t") * F.col("t")), F.col("agree") / F.col("t")
    return joined.select(*by, F.col("t").alias("n"), po.alias("agreement"), F.when(1 - pe < 1e-12, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def krippendorff_alpha(ratings: DataFrame, unit: str, value: str, ordinal: bool = False) -> DataFrame:
    """1 - observed / expected disagreement over pairs within units and over all values.

    Works on value counts (unit, value), so a unit with many raters makes no pair rows.
    """
    cells = ratings.filter(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count(F.lit(1)).alias("n"))
    sized = cells.withColumn("m", F.sum("n").over(Window.partitionBy(unit))).filter("m > 1")

    def apart(x: Column, y: Column) -> Column:
        return (x - y) * (x - y) if ordinal else (x != y).cast("double")

    left, right = sized.select(unit, F.col(value).alias("x"), F.col("n").alias("nx"), "m"), sized.select(unit, F.col(value).alias("y"), F.col("n").alias("ny"))
    observed = left.join(right, unit).agg(F.sum(F.col("nx") * F.col("ny") * apart(F.col("x"), F.col("y")) / (F.col("m") - 1)).alias("do"))
    values = sized.groupBy(value).agg(F.sum("n").alias("n"))
    a, b = values.select(F.col(value).alias("x"), F.col("n").alias("nx")), values.select(F.col(value).alias("y"), F.col("n").alias("ny"))
    expected = a.join(b, F.col("x") <= F.col("y")).agg(F.sum(F.when(F.col("x") == F.col("y"), 0.0).otherwise(2.0 * F.col("nx") * F.col("ny") * apart(F.col("x"), F.col("y")))).alias("de"))
    total = sized.agg(F.sum("n").alias("t"))
    one = observed.crossJoin(expected).crossJoin(total)
    return one.select(F.col("t").alias("ratings"), F.when(F.col("de") == 0, 1.0).otherwise(1 - (F.col("do") / F.col("t")) / (F.col("de") / (F.col("t") * (F.col("t") - 1)))).alias("alpha"))


def fleiss_kappa(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """Fleiss' kappa of items with a fixed number of raters."""
    cells = ratings.groupBy(item, label).agg(F.count(F.lit(1)).alias("n"))
    items = cells.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("s")).filter("r > 1")
    p = items.agg(F.avg(F.col("s") / (F.col("r") * (F.col("r") - 1))).alias("po"), F.sum("r").alias("t"), F.count(F.lit(1)).alias("items"))
    kept = cells.join(items.select(item), item, "left_semi").groupBy(label).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    pe = F.col("q") / (F.col("t") * F.col("t"))
    return p.crossJoin(kept).select("items", F.when(1 - pe < 1e-12, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def macro_f1(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Mean F1 over the labels observed on either side."""
    both = F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(predicted)).cast("int").alias("tp")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("tp"))))
    sums = rows.select(both.alias("r")).groupBy("r.label").agg(F.sum("r.g").alias("g"), F.sum("r.p").alias("p"), F.sum("r.tp").alias("tp"))
    return sums.agg(F.avg(2 * F.col("tp") / (F.col("g") + F.col("p"))).alias("macro_f1"), F.count(F.lit(1)).alias("labels"))


def paired_effect(rows: DataFrame, cluster: str, condition: str, value: str, treated: str, control: str) -> DataFrame:
    """Mean difference treated - control within each cluster; clusters lacking a condition are reported as null."""
    means = rows.groupBy(cluster).agg(F.avg(F.when(F.col(condition) == treated, F.col(value))).alias("t"), F.avg(F.when(F.col(condition) == control, F.col(value))).alias("c"))
    return means.select(cluster, (F.col("t") - F.col("c")).alias("effect"))


def factorial_contrasts(rows: DataFrame, cluster: str, a: str, b: str, value: str) -> DataFrame:
    """Equal-cluster main effects and interaction of a 2 x 2 design with 0/1 factors."""

    def cell(x: int, y: int) -> Column:
        return F.avg(F.when((F.col(a) == x) & (F.col(b) == y), F.col(value))).alias(f"c{x}{y}")

    cells = rows.groupBy(cluster).agg(*[cell(x, y) for x in (0, 1) for y in (0, 1)])
    main_a = (F.col("c10") + F.col("c11") - F.col("c00") - F.col("c01")) / 2
    main_b = (F.col("c01") + F.col("c11") - F.col("c00") - F.col("c10")) / 2
    return cells.agg(F.avg(main_a).alias("main_a"), F.avg(main_b).alias("main_b"), F.avg(F.col("c11") - F.col("c10") - F.col("c01") + F.col("c00")).alias("interaction"), F.count(F.lit(1)).alias("clusters"))


def randomization_test(rows: DataFrame, unit: str, arm: str, value: str, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """Fisher test of a mean difference: arms re-dealt by hash order, (1 + hits) / (1 + replicates), with its standard error.

    ``rows`` are the experiment's units, so few; each replicate ranks them once.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(unit).alias("u"), F.col(arm).cast("int").alias("a"), F.col(value).cast("double").alias("v"))
    fixed = base.agg(F.sum("a").alias("n1"), F.count(F.lit(1)).alias("n"), (F.avg(F.when(F.col("a") == 1, F.col("v"))) - F.avg(F.when(F.col("a") == 0, F.col("v")))).alias("effect"))
    dealt = spark.range(replicates).select(F.col("id").alias("replicate")).join(F.broadcast(base.select("u", "v")))
    rank = F.row_number().over(Window.partitionBy("replicate").orderBy(F.xxhash64(F.lit(seed), "replicate", "u"), "u"))
    dealt = dealt.withColumn("rank", rank).crossJoin(F.broadcast(fixed))
    treated = F.col("rank") <= F.col("n1")
    stats = dealt.groupBy("replicate", "effect").agg((F.avg(F.when(treated, F.col("v"))) - F.avg(F.when(~treated, F.col("v")))).alias("e"))
    out = stats.groupBy("effect").agg(((1 + F.count_if(F.abs("e") >= F.abs("effect") - 1e-12)) / F.lit(replicates + 1)).alias("p_value"))
    return out.withColumn("standard_error", F.sqrt(F.col("p_value") * (1 - F.col("p_value")) / replicates))


def aurc(rows: DataFrame, by: list[str], risk: str, error: str, case: str) -> DataFrame:
    """Area under the risk-coverage curve: mean over the ranking by risk of the errors so far over the cases so far."""
    order = Window.partitionBy(*by).orderBy(risk, case).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.sum(F.col(error).cast("double")).over(order) / F.count(F.lit(1)).over(order))
    return rows.groupBy(*by).agg(F.avg("__s").alias("aurc"), F.count(F.lit(1)).alias("cases"))


def equivalence_test(effects: DataFrame, value: str, margin: float) -> DataFrame:
    """Two one-sided sign-flip tests of -margin < mean < margin; the larger p-value decides."""
    low = sign_flip_test(effects.select((F.col(value) + margin).alias("x")), "x").select(F.col("p_greater").alias("p_low"))
    high = sign_flip_test(effects.select((margin - F.col(value)).alias("x")), "x").select(F.col("p_greater").alias("p_high"))
    return low.crossJoin(high).select("p_low", "p_high", F.greatest("p_low", "p_high").alias("p_value"))


def power_simulation(spark, topics: int, effect: float, replicates: int = 1000, seed: int = 3, alpha: float = 0.05) -> DataFrame:
    """Power of the exact sign-flip test for standardized normal topic effects, by simulation in one plan."""
    if topics > 12:
        raise ValueError("at most 12 topics: each replicate enumerates 2^topics patterns")
    normal = [F.sqrt(-2 * F.log(1 - uniform(F.lit(seed), F.col("id"), F.lit(k), F.lit("a")))) * F.cos(2 * math.pi * uniform(F.lit(seed), F.col("id"), F.lit(k), F.lit("b"))) + effect for k in range(topics)]
    rows = spark.range(replicates).select("id", F.array(*normal).alias("x"))
    rows = rows.select("id", "x", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"), F.explode(F.sequence(F.lit(0), F.lit((1 << topics) - 1))).alias("pattern"))
    flipped = F.aggregate(F.transform("x", lambda v, i: F.when(F.getbit(F.col("pattern"), i) == 1, -v).otherwise(v)), F.lit(0.0), lambda a, v: a + v)
    p = rows.groupBy("id").agg(F.avg((F.abs(flipped) >= F.abs("total") - 1e-12).cast("double")).alias("p"))
    return p.agg(F.avg((F.col("p") <= alpha).cast("double")).alias("power"), F.count(F.lit(1)).alias("replicates"))


def prediction_scores(rows: DataFrame, gold: str, predicted: str, positive: int = 1) -> DataFrame:
    """Accuracy, recall of the positive class, false interventions and abstention in one pass."""
    g, p = F.col(gold) == positive, F.col(predicted) == positive
    known = F.col(predicted).isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(F.col(gold) == F.col(predicted), F.lit(False)).cast("double")).alias("accuracy"),
        (F.count_if(g & p) / F.count_if(g)).alias("recall"),
        (F.count_if(~g & p) / F.count_if(~g)).alias("false_intervention_rate"),
        F.avg((~known).cast("double")).alias("abstention_rate"),
    )


def nested_mean(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Mean of case means within each dataset, then over datasets."""
    cases = rows.groupBy(outer, inner).agg(F.avg(value).alias("m"))
    return cases.groupBy(outer).agg(F.avg("m").alias("m")).agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("datasets"))


def family_summary(rows: DataFrame, family: str, measure: str, value: str) -> DataFrame:
    """Minimum, maximum, mean and count of each measure by perturbation family."""
    return rows.groupBy(family, measure).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.count(value).alias("n"))
