"""Review routing: capability with back-off, expected-loss routing, audit sampling, resolution, replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions.text import hash_fraction


def capability(feedback: DataFrame, prior: tuple[float, float] = (1.0, 1.0), least: int = 5) -> DataFrame:
    """Beta-posterior accuracy of (reviewer, domain, issue) at every level: exact, issue, domain, reviewer, all.

    ``feedback`` has (reviewer, domain, issue, correct 0/1); one pass with GROUPING SETS. Levels with fewer
    than ``least`` observations are marked as not usable, so that a look-up backs off.
    """
    who, what, issue = (F.col(x) for x in ("reviewer", "domain", "issue"))
    grouped = feedback.groupingSets([[who, what, issue], [who, issue], [who, what], [who], []], who, what, issue)
    rows = grouped.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("correct").alias("k"))
    level = F.when(F.col("g") == 0, "exact").when(F.col("g") == 2, "issue").when(F.col("g") == 1, "domain").when(F.col("g") == 3, "reviewer").otherwise("all")
    mean = (F.col("k") + prior[0]) / (F.col("n") + prior[0] + prior[1])
    return rows.select("reviewer", "domain", "issue", level.alias("level"), "n", mean.alias("accuracy"), (F.col("n") >= least).alias("usable"))


def route(cases: DataFrame, reviewers: DataFrame, audit_cost: float = 0.0) -> DataFrame:
    """The option of least expected loss for each case: auto, or the best single reviewer.

    ``cases``: case_id, domain, risk (chance that auto is wrong), harm; ``reviewers``: reviewer, domain, accuracy, cost.
    """
    options = cases.join(reviewers, "domain", "left")
    loss = (1 - F.col("accuracy")) * F.col("harm") + F.col("cost")
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(loss.asc_nulls_last(), F.col("reviewer").asc_nulls_last()))
    best = options.withColumn("loss", loss).withColumn("rank", rank).filter("rank = 1")
    auto = F.col("risk") * F.col("harm") + audit_cost
    manual = F.col("loss").isNotNull() & (F.col("loss") < auto)
    return best.select("case_id", F.when(manual, "single").otherwise("auto").alias("option"), F.when(manual, F.col("reviewer")).alias("reviewer"), F.when(manual, F.col("loss")).otherwise(auto).alias("expected_loss"))


def adaptive_policy(items: DataFrame, history: DataFrame, least_datasets: int = 2, accept: float = 0.95, audit_rate: float = 0.1, seed: str = "audit") -> DataFrame:
    """request / auto_accept / audit for items (item_id, issue, severity) given history (issue, dataset, accepted 0/1)."""
    record = history.groupBy("issue").agg(F.countDistinct("dataset").alias("datasets"), F.avg(F.col("accepted").cast("double")).alias("rate"))
    rows = items.join(record, "issue", "left")
    safe = (F.col("severity") != "critical") & (F.coalesce("datasets", F.lit(0)) >= least_datasets) & (F.coalesce("rate", F.lit(0.0)) >= accept)
    audited = hash_fraction(F.lit(seed), F.col("item_id")) < audit_rate
    return rows.select("item_id", F.when(~safe, "request").when(audited, "audit").otherwise("auto_accept").alias("decision"))


def review_program_summary(actions: DataFrame) -> DataFrame:
    """Counts and rates of decisions; ``actions`` has (decision, correct 0/1 or null)."""
    auto = F.col("decision") == "auto_accept"
    return actions.agg(F.count(F.lit(1)).alias("items"), F.count_if(auto).alias("auto_accepts"), F.avg((~auto).cast("double")).alias("request_rate"), F.coalesce(F.try_divide(F.count_if(auto & (F.col("correct") == 0)), F.count_if(auto & F.col("correct").isNotNull())), F.lit(0.0)).alias("unsafe_rate"))


def resolve(reviews: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Two-reviewer resolution: agreement, else the adjudicator, else open.

    ``reviews``: item_id, reviewer, label; ``adjudications``: item_id, label.
    """
    once = reviews.groupBy("item_id").agg(F.countDistinct("reviewer").alias("reviewers"), F.countDistinct("label").alias("labels"), F.min("label").alias("label"))
    rows = once.join(adjudications.select("item_id", F.col("label").alias("final")), "item_id", "left")
    agreed = (F.col("reviewers") >= 2) & (F.col("labels") == 1)
    return rows.select("item_id", F.when(agreed, "agreed").when(F.col("final").isNotNull(), "adjudicated").otherwise("open").alias("status"), F.when(agreed, F.col("label")).otherwise(F.col("final")).alias("label"))


def conflicts(judgments: DataFrame) -> DataFrame:
    """Items on which judges differ, with the sorted labels."""
    rows = judgments.groupBy("item_id").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.countDistinct("judge").alias("judges"))
    return rows.filter((F.size("labels") > 1) & (F.col("judges") > 1))


def judge_totals(judgments: DataFrame) -> DataFrame:
    """Wins, ties and preference (wins + ties / 2) / n of each condition; ``judgments``: condition, outcome."""
    wins, ties = F.count_if(F.col("outcome") == "win"), F.count_if(F.col("outcome") == "tie")
    return judgments.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), wins.alias("wins"), ties.alias("ties"), ((wins + ties / 2) / F.count(F.lit(1))).alias("preference"))


def balanced_sample(items: DataFrame, key: str, stratum: str, take: int, seed: str) -> DataFrame:
    """Round-robin over strata in hash order, with inverse-probability weights; ``take`` is the sample's size."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    ring = F.sha2(F.concat_ws("|", F.lit(seed), F.col(stratum).cast("string")), 256)
    rows = items.select(key, stratum, order.alias("__o"), ring.alias("__s"))
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(stratum).orderBy("__o", key)))
    chosen = rows.filter(F.col("__rank") <= take).orderBy("__rank", "__s", key).limit(take)
    sizes = items.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    taken = chosen.groupBy(stratum).agg(F.count(F.lit(1)).alias("taken"))
    return chosen.select(key, stratum).join(F.broadcast(taken), stratum).join(sizes, stratum).select(key, stratum, (F.col("size") / F.col("taken")).alias("weight"))


def greedy_budget(targets: DataFrame, group: str, budget: float) -> DataFrame:
    """Per group: by priority, every target that still fits its budget; mandatory ones always. Skipped ones cost nothing, so this is sequential.

    ``targets``: group, target_id, priority, cost, mandatory.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mandatory", "priority", "target_id"], ascending=[False, False, True])
        left, kept = budget, []
        for m, c in zip(rows["mandatory"], rows["cost"], strict=True):
            kept.append(bool(m) or c <= left)
            left -= c if kept[-1] else 0
        rows = rows[kept][[group, "target_id", "cost"]]
        return rows.assign(order=range(1, len(rows) + 1))

    kind = dict(targets.dtypes)
    return targets.groupBy(group).applyInPandas(pick, f"{group} {kind[group]}, target_id {kind['target_id']}, cost double, order long")


def sequential_replay(claims: DataFrame, article: str, budget: float) -> DataFrame:
    """Value-of-information replay per article: check the claim of largest expected gain per cost, spread its outcome to dependants, repeat.

    ``claims``: article, claim_id, risk, harm, cost, truth (0/1 wrong), depends array of claim ids.
    """

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("claim_id").reset_index(drop=True)
        at = {c: k for k, c in enumerate(rows["claim_id"])}
        risk, done, left, out = rows["risk"].astype(float).tolist(), set(), budget, []
        children: dict[int, list[int]] = {}
        for k, deps in enumerate(rows["depends"]):
            for d in deps if deps is not None else ():
                if d in at:
                    children.setdefault(at[d], []).append(k)
        while True:
            options = [k for k in range(len(rows)) if k not in done and rows["cost"][k] <= left]
            if not options:
                break
            k = max(options, key=lambda j: (risk[j] * rows["harm"][j] * (1 + len(children.get(j, ()))) / max(rows["cost"][j], 1e-9), -j))
            done.add(k)
            left -= rows["cost"][k]
            out.append((rows[article][k], rows["claim_id"][k], len(out) + 1, risk[k], int(rows["truth"][k])))
            for j in children.get(k, ()):
                risk[j] = min(1.0, risk[j] + (1 - risk[j]) * 0.5) if rows["truth"][k] else risk[j] * 0.5
        return pd.DataFrame(out, columns=[article, "claim_id", "step", "risk_then", "wrong"])

    kind = dict(claims.dtypes)
    return claims.groupBy(article).applyInPandas(replay, f"{article} {kind[article]}, claim_id {kind['claim_id']}, step long, risk_then double, wrong int")


def dependency_features(claims: DataFrame) -> DataFrame:
    """Fan-out, fan-in and risk of claims (claim_id, risk, depends)."""
    links = claims.select(F.col("claim_id").alias("child"), F.explode("depends").alias("claim_id")).distinct()
    out = links.groupBy("claim_id").agg(F.count(F.lit(1)).alias("fan_out"))
    return claims.join(out, "claim_id", "left").select("claim_id", "risk", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.size(F.array_distinct("depends")).alias("fan_in"), (F.col("risk") * (1 + F.coalesce("fan_out", F.lit(0)))).alias("score"))


def issue_flags(stats: DataFrame, rules: dict[str, tuple[str, float, str]]) -> DataFrame:
    """(key, issue, severity) for every rule (column, least value, severity) that a row breaks."""
    flags = [F.when(F.col(c) < least, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"))) for name, (c, least, severity) in rules.items()]
    return stats.select("key", F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())).alias("f")).select("key", "f.issue", "f.severity")


def leak_scan(texts: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """Texts that name a condition."""
    low = F.lower(F.regexp_replace(text, r"[\s_-]+", " "))
    hits = F.filter(F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return texts.select(key, hits.alias("terms")).filter(F.size("terms") > 0)


def promotion_gate(outcomes: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Whether a policy's rates stay within their limits; ``outcomes`` has one 0/1 column per limit."""
    rates = outcomes.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in limits])
    held = F.lit(True)
    for c, most in limits.items():
        held = held & (F.coalesce(F.col(c), F.lit(1.0)) <= most)
    return rates.withColumn("promoted", held)
