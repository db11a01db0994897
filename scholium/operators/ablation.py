"""Scores of predictions against gold, paired ablations, cluster bootstraps, feedback credit and review priority."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import text as T


def _share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def score_predictions(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every item with what its prediction is worth; an item without one is wrong and answers nothing.

    ``items``: item_id, answerable, answer, statement, evidence (array); ``predictions``: item_id, abstain, answer, statement,
    evidence. A prediction is valid if abstain is set and it abstains or answers; of several of one id, any (give one).
    Where an item is not answerable, only abstaining is right. A statement is a claim unless it is empty, abstained or code.
    """
    p = predictions.select("item_id", "abstain", F.col("answer").alias("given"), F.col("statement").alias("said"), F.col("evidence").alias("cited"))
    rows = items.join(p, "item_id", "left")
    valid = F.coalesce(F.col("abstain").isNotNull() & (F.col("abstain") | F.col("given").isNotNull()), F.lit(False))
    rows = rows.withColumn("schema_valid", valid).withColumn("abstained", F.col("schema_valid") & F.col("abstain"))
    rows = rows.withColumn("correct", F.col("schema_valid") & F.when(F.col("answerable"), ~F.col("abstained") & F.coalesce(F.col("given") == F.col("answer"), F.lit(False))).otherwise(F.col("abstained")))
    said = F.trim(F.coalesce("said", F.lit("")))
    rows = rows.withColumn("statement_claim", ~F.col("abstained") & (said != "") & ~F.rlike(said, F.lit(r"^(\{|\[|```)")))
    rows = rows.withColumn("statement_supported", F.when(F.col("statement_claim"), F.col("answerable") & F.coalesce(T.normalize_statement(said) == T.normalize_statement(F.coalesce("statement", F.lit(""))), F.lit(False))))
    none = F.array().cast("array<string>")
    gold, cited = (F.array_distinct(F.coalesce(c, none)) for c in ("evidence", "cited"))
    rows = rows.withColumns({"evidence_tp": F.size(F.array_intersect(gold, cited)), "evidence_fp": F.size(F.array_except(cited, gold)), "evidence_fn": F.size(F.array_except(gold, cited))})
    path = F.when(~F.col("abstained"), (F.size(cited) > 0) & (F.col("evidence_fp") == 0))
    return rows.withColumn("evidence_valid", path).drop("abstain", "given", "said", "cited")


def prediction_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, validity, unsupported claims, evidence and abstention of :func:`score_predictions` rows, in one aggregate."""
    yes = F.count_if
    answered, claims = yes(~F.col("abstained")), yes("statement_claim")
    tp, fp, fn = (F.sum(c) for c in ("evidence_tp", "evidence_fp", "evidence_fn"))
    right, wrong, missed = yes(F.col("abstained") & ~F.col("answerable")), yes(~F.col("abstained") & ~F.col("answerable")), yes(F.col("abstained") & F.col("answerable"))
    eligible = F.count("evidence_valid")
    # as counted, a false positive is an answer to what has none, a false negative an abstention from what has one
    precision, recall = _share(right, right + wrong), _share(right, right + missed)
    sums = scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("items"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(F.col("schema_valid").cast("double")).alias("schema_valid_rate"),
        _share(claims - yes("statement_supported"), claims).alias("unsupported_claim_rate"),
        _share(yes(~F.col("abstained") & ~F.col("correct")), answered).alias("unsupported_answer_rate"),
        _share(claims, yes("answerable")).alias("statement_claim_coverage"),
        _share(yes("evidence_valid"), eligible).alias("evidence_path_validity"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.when(fn > 0, 0.0).otherwise(1.0)).alias("evidence_precision"),
        _share(tp, tp + fn, 1.0).alias("evidence_recall"),
        precision.alias("abstention_precision"),
        recall.alias("abstention_recall"),
    )
    total = F.col("abstention_precision") + F.col("abstention_recall")
    return sums.withColumn("abstention_f1", _share(2 * F.col("abstention_precision") * F.col("abstention_recall"), total))


def paired_ablation(first: DataFrame, second: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracies of two conditions over the same items, their difference, and the discordant items of each side.

    Both have item_id and correct (and ``by``, taken from the first); an item that one lacks is an error when read.
    """
    a = first.select("item_id", *(by or []), F.col("correct").alias("a"), F.lit(1).alias("__a"))
    b = second.select("item_id", F.col("correct").alias("b"), F.lit(1).alias("__b"))
    both = a.join(b, "item_id", "full")
    whole = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unpaired item: "), F.col("item_id").cast("string"))).cast("boolean"))
    rows = both.filter(whole)
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("items"),
        F.avg(F.col("a").cast("double")).alias("first_accuracy"),
        F.avg(F.col("b").cast("double")).alias("second_accuracy"),
        F.avg(F.col("a").cast("double") - F.col("b").cast("double")).alias("difference"),
        F.count_if(F.col("a") & ~F.col("b")).alias("first_only"),
        F.count_if(~F.col("a") & F.col("b")).alias("second_only"),
    )


def ablation_interval(pairs: DataFrame, stratum: str, a: str, b: str, replicates: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile intervals of the accuracy difference over resampled items: of all, and within each stratum.

    Items with equal (stratum, a, b) are exchangeable, so they are counted first, and a replicate is one multinomial draw over
    these few counts: the same distribution as drawing items, at a cost that does not grow with them. Blocks of replicates are
    tasks with a generator of their own (seed, block). Strata are taken to be few (datasets); their number is checked.
    """
    gain = F.col(a).cast("int") - F.col(b).cast("int")
    counts = pairs.groupBy(F.col(stratum).alias("s"), gain.alias("g")).agg(F.count(F.lit(1)).alias("n")).orderBy("s", "g").limit(300_001).collect()
    if not counts or len(counts) > 300_000:
        raise ValueError("ablation_interval takes 1 to 100000 strata of paired items")
    size = 500

    def run(batches):
        import numpy as np

        g, n = np.array([r["g"] for r in counts], float), np.array([r["n"] for r in counts])
        starts = [k for k, r in enumerate(counts) if k == 0 or r["s"] != counts[k - 1]["s"]]
        for batch in batches:
            for block in batch["id"]:
                draw = np.random.default_rng([seed, block])
                m = min(size, replicates - block * size)
                free = draw.multinomial(n.sum(), n / n.sum(), m) @ g / n.sum()
                held = np.zeros(m)
                for i, j in zip(starts, [*starts[1:], len(n)], strict=True):
                    part = n[i:j]
                    held += draw.multinomial(part.sum(), part / part.sum(), m) @ g[i:j]
                yield pd.DataFrame({"free": free, "stratified": held / n.sum()})

    blocks = -(-replicates // size)
    rows = pairs.sparkSession.range(0, blocks, 1, min(blocks, 64)).mapInPandas(run, "free double, stratified double")
    tail = (1 - level) / 2
    ends = [F.percentile(c, q).alias(f"{c}_{side}") for c in ("free", "stratified") for side, q in (("low", tail), ("high", 1 - tail))]
    total = sum(r["n"] for r in counts)
    return rows.agg(*ends).select(F.lit(sum(r["g"] * r["n"] for r in counts) / total).alias("difference"), "*")


def topic_bootstrap(rows: DataFrame, topic: str, article: str, affected: Column, replicates: int = 5000, seed: int = 20260908) -> DataFrame:
    """Intervals of the share of affected rows, and of articles with such a row, over resampled topics.

    A topic drawn twice counts twice, its articles too. Each topic is reduced to four sums first, so a replicate adds up one
    short row a draw. Draws come from md5(seed|replicate|draw); interval ends are order statistics, the lower neighbour.
    Rows without a topic make the result null, as do no rows; the number of topics is checked.
    """
    a = rows.select(F.col(topic).alias("t"), F.col(article).alias("x"), F.coalesce(affected, F.lit(False)).alias("bad"))
    articles = a.groupBy("t", "x").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("k"))
    sums = articles.groupBy("t").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("m"), F.count_if(F.col("k") > 0).alias("j"))
    held = sums.orderBy(F.asc_nulls_first("t")).limit(10_001).collect()
    if len(held) > 10_000:
        raise ValueError("topic_bootstrap takes at most 10000 topics")
    spark = rows.sparkSession
    if not held or held[0]["t"] is None:
        return spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in ("row_low", "row_high", "article_low", "article_high")])
    table = F.broadcast(spark.createDataFrame([(i, r["n"], r["k"], r["m"], r["j"]) for i, r in enumerate(held)], "pick long, n long, k long, m long, j long"))
    draws = spark.range(replicates).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(len(held) - 1))).alias("d"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("d").cast("string")))
    draws = draws.withColumn("pick", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % len(held)).join(table, "pick")
    rates = draws.groupBy("r").agg((F.sum("k") / F.sum("n")).alias("row"), (F.sum("j") / F.sum("m")).alias("article"))
    order = rates.agg(F.array_sort(F.collect_list("row")).alias("row"), F.array_sort(F.collect_list("article")).alias("article"))  # one number a replicate
    return order.select(*[F.get(c, F.lit(int(q * (replicates - 1)))).alias(f"{c}_{side}") for c in ("row", "article") for side, q in (("low", 0.025), ("high", 0.975))])


def deletion_decomposition(rows: DataFrame) -> DataFrame:
    """How far a variant's loss after a deletion is the deletion's, and how far the variant's own.

    ``rows``: before, after, varied_before, varied_after (fractions of nodes in the largest part). The total change equals the
    change before the deletion less the additional loss; a row where it does not is an error.
    """
    change, loss = F.col("varied_before") - F.col("before"), (F.col("varied_before") - F.col("varied_after")) - (F.col("before") - F.col("after"))
    out = rows.withColumns({"base_loss": F.col("before") - F.col("after"), "varied_loss": F.col("varied_before") - F.col("varied_after"), "change_before": change, "additional_loss": loss, "total_change": F.col("varied_after") - F.col("after")})
    off = F.abs(F.col("total_change") - (F.col("change_before") - F.col("additional_loss"))) > 1e-9
    return out.filter(F.when(off, F.raise_error(F.lit("the decomposition does not add up")).cast("boolean")).otherwise(True))


def swap_windows(trend: DataFrame, year: str = "year", span: int = 3) -> DataFrame:
    """The first and the last ``span`` observed years change places, so totals over all years stay; fewer than 2 ``span`` years are an error."""
    years = trend.agg(F.array_sort(F.collect_set(year)).alias("__ys"))  # distinct years only
    at = F.array_position("__ys", F.col(year)).cast("int")
    size = F.size("__ys")
    new = F.when(at <= span, F.get("__ys", size - span + at - 1)).when(at > size - span, F.get("__ys", at - (size - span) - 1)).otherwise(F.col(year))
    enough = F.when(size < 2 * span, F.raise_error(F.lit("too few years for two windows"))).otherwise(new)
    return trend.crossJoin(F.broadcast(years)).withColumn(year, F.when(F.col(year).isNotNull(), enough).cast(trend.schema[year].dataType)).drop("__ys")


def scale_pairs(tasks: DataFrame, kind: str, scale: str, anchor: list[str], scales: list[str]) -> DataFrame:
    """Kinds of task whose anchor fields agree over all ``scales``, with these fields."""
    same = tasks.filter(F.col(scale).isin(scales)).groupBy(kind).agg(F.countDistinct(scale).alias("scales"), F.count_distinct(F.struct(*anchor)).alias("answers"), *[F.min(c).alias(c) for c in anchor])
    return same.filter((F.col("scales") == len(scales)) & (F.col("answers") == 1)).select(kind, *anchor)


def feedback_credit(feedback: DataFrame) -> DataFrame:
    """Feedback (feedback_id, target_type, action, replacement) with the component it teaches, reward and kind of supervision.

    What blames something other than its target goes to the risk router as an escalation. A rewrite without a replacement,
    an unknown target or action is an error.
    """
    target, action = F.col("target_type"), F.col("action")
    owner = F.when(target == "evidence", "retriever").when(target.isin("operator", "plan"), "planner").when(target == "claim", "generator")
    fits = action == F.concat(F.lit("reject_"), target)
    known = action.isin("accept", "rewrite", "abstain", "reject_claim", "reject_evidence", "reject_operator", "reject_plan") & owner.isNotNull()
    fault = ~F.coalesce(known, F.lit(False)) | (action == "rewrite") & F.col("replacement").isNull()
    away = (action == "abstain") | F.startswith(action, F.lit("reject_")) & ~fits
    return feedback.filter(F.when(fault, F.raise_error(F.concat(F.lit("feedback that teaches nothing: "), F.col("feedback_id").cast("string"))).cast("boolean")).otherwise(True)).select(
        "feedback_id",
        F.when(away, "risk_router").otherwise(owner).alias("component"),
        F.when(fits, -1.0).otherwise(1.0).alias("reward"),
        F.when(away, "escalation").when(action == "rewrite", "pairwise_preference").otherwise("pointwise").alias("supervision"),
        F.when(action == "rewrite", F.col("replacement")).alias("preferred"),
    )


# The weight of harm by severity.
HARM = {"low": 1.0, "medium": 3.0, "high": 8.0, "critical": 20.0}


def review_priority(targets: DataFrame, feedback: DataFrame, second_cost: float = 0.03, novelty: float = 1.0, threshold: float = 1.0) -> DataFrame:
    """Targets with the utility of reviewing them: expected harm + novelty - cost.

    ``targets``: target_id, issue, guard, severity, descendants, seconds; ``feedback``: issue, guard, action, guard null where it
    holds for the whole issue. Errors among the feedback that applies give a Beta(1 + errors, 1 + accepted) posterior. Feedback is
    counted by (issue, guard) first, so each target meets at most two rows of counts. Critical targets are always reviewed.
    """
    wrong = (F.col("action") != "accept").cast("long")
    counted = feedback.groupBy("issue", "guard").agg(F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("e"))
    exact = counted.filter("guard IS NOT NULL").select("issue", "guard", F.col("n").alias("n1"), F.col("e").alias("e1"))
    broad = counted.filter("guard IS NULL").select("issue", F.col("n").alias("n2"), F.col("e").alias("e2"))
    rows = targets.join(exact, ["issue", "guard"], "left").join(broad, "issue", "left")
    rows = rows.withColumn("examples", F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).withColumn("errors", F.coalesce("e1", F.lit(0)) + F.coalesce("e2", F.lit(0)))
    alpha, beta = 1.0 + F.col("errors"), 1.0 + F.col("examples") - F.col("errors")
    total = alpha + beta
    rows = rows.withColumns({"error_probability": alpha / total, "variance": alpha * beta / (total * total * (total + 1))})
    harm = F.create_map(*[F.lit(x) for kv in HARM.items() for x in kv])[F.col("severity")]
    utility = F.col("error_probability") * harm * (1 + F.log1p(F.col("descendants").cast("double"))) + novelty * F.sqrt("variance") - F.col("seconds") * second_cost
    rows = rows.withColumn("priority", utility).withColumn("mandatory", F.col("severity") == "critical")
    return rows.select("target_id", "examples", "errors", "error_probability", "priority", "mandatory", (F.col("mandatory") | (F.col("priority") >= threshold)).alias("review"), "seconds")
