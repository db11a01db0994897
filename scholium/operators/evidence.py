"""Evidence programs: claim binding, allow-listed numbers, representative works, temporal vectors, sentence budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions.text import evidence_ids, is_placeholder


def bind_claims(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, claim, body, evidence, unknown): paragraphs that cite evidence, with ids that ``known`` (evidence_id) lacks."""
    parts = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n")).alias("paragraph", "body"))
    cited = parts.withColumn("evidence", evidence_ids(F.col("body"))).filter(F.size("evidence") > 0)
    flat = cited.select(key, "paragraph", F.explode("evidence").alias("evidence_id")).join(known.select("evidence_id"), "evidence_id", "left_anti")
    missing = flat.groupBy(key, "paragraph").agg(F.array_sort(F.collect_set("evidence_id")).alias("unknown"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("paragraph"))
    return cited.join(missing, [key, "paragraph"], "left").select(key, number.alias("claim"), "body", "evidence", F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"))


def unexpected_numbers(texts: DataFrame, key: str, text: str, allowed: DataFrame) -> DataFrame:
    """(key, number): numbers of a text that ``allowed`` (number as string) does not list; thousands separators dropped."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d),(?=\d{3}\b)", ""), F.lit(r"(?<![\w.])\d+(?:\.\d+)?(?![\w])"), F.lit(0))
    rows = texts.select(key, F.explode(F.array_distinct(found)).alias("number"))
    return rows.join(allowed.select("number").distinct(), "number", "left_anti").select(key, "number")


def representative_works(works: DataFrame, memberships: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """The k most cited works (then newest, then smallest id) of each label, matched without case."""
    wanted = labels.select(F.lower(F.trim("label")).alias("__k"), "label").distinct()
    rows = memberships.select("work_id", F.lower(F.trim("keyword")).alias("__k")).distinct().join(wanted, "__k").join(works.select("work_id", "cited_by_count", "year"), "work_id")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc_nulls_last("cited_by_count"), F.desc_nulls_last("year"), "work_id"))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("label", "rank", "work_id")


def temporal_vectors(trend: DataFrame, term: str, years: list[int]) -> DataFrame:
    """(term, counts): one dense, zero-filled vector over ``years`` for each term."""
    return trend.groupBy(term).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("year") == y, F.col("works"))), F.lit(0)) for y in years]).alias("counts"))


def identity_audit(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, bad_rows, bad_ids): placeholder identities by table."""
    out = None
    for name, (df, column) in tables.items():
        bad = is_placeholder(F.col(column).cast("string"))
        row = df.agg(F.lit(name).alias("table"), F.count_if(bad).alias("bad_rows"), F.countDistinct(F.when(bad, F.coalesce(F.col(column).cast("string"), F.lit("")))).alias("bad_ids"))
        out = row if out is None else out.unionByName(row)
    return out


def normalized_claim_quality(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Supported and unsupported claims per 1000 words of each condition; ``claims``: article, supported; ``articles``: article, condition, words."""
    counts = claims.groupBy("article").agg(F.count_if("supported").alias("good"), F.count_if(~F.col("supported")).alias("bad"))
    rows = articles.join(counts, "article", "left").na.fill(0, ["good", "bad"])
    sums = rows.groupBy("condition").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.sum("words").alias("w"), F.count(F.lit(1)).alias("articles"))
    return sums.select("condition", "articles", F.try_divide(1000 * F.col("g"), "w").alias("supported_per_1000"), F.try_divide(1000 * F.col("b"), "w").alias("unsupported_per_1000"))


def greedy_sources(ranked: DataFrame, group: str) -> DataFrame:
    """One source for each label of a group, best score first, none used twice; sequential, so one task a group.

    ``ranked``: group, label, source_id, score.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for label in sorted(rows["label"].unique()):
            part = rows[rows["label"] == label].sort_values(["score", "source_id"], ascending=[False, True])
            best = next((s for s in part["source_id"] if s not in used), None)
            if best is not None:
                used.add(best)
                out.append((rows[group].iloc[0], label, best))
        return pd.DataFrame(out, columns=[group, "label", "source_id"])

    kind = dict(ranked.dtypes)
    return ranked.groupBy(group).applyInPandas(pick, f"{group} {kind[group]}, label {kind['label']}, source_id {kind['source_id']}")


def word_budget(sentences: DataFrame, article: str, high: int) -> DataFrame:
    """Sentences that stay when the least valuable ones go until an article has at most ``high`` words; required ones stay.

    ``sentences``: article, position, words, value, required.
    """

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position").reset_index(drop=True)
        total, gone = int(rows["words"].sum()), set()
        for k in rows[~rows["required"]].sort_values(["value", "position"], ascending=[True, False]).index:
            if total <= high:
                break
            gone.add(k)
            total -= int(rows["words"][k])
        return rows.drop(index=list(gone))[[article, "position", "words"]]

    kind = dict(sentences.dtypes)
    return sentences.groupBy(article).applyInPandas(cut, f"{article} {kind[article]}, position {kind['position']}, words {kind['words']}")


def claims_for_review(claims: DataFrame, article: str, per_phenomenon: int, take: int) -> DataFrame:
    """At least ``per_phenomenon`` claims of each phenomenon by risk, then the riskiest up to ``take``; claims may be shared.

    ``claims``: article, claim_id, risk, phenomena array<string>.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["risk", "claim_id"], ascending=[False, True])
        chosen: list[int] = []
        names = sorted({p for ps in rows["phenomena"] for p in ps})
        for name in names:
            have = sum(name in rows["phenomena"][k] for k in chosen)
            for k in rows.index:
                if have >= per_phenomenon:
                    break
                if k not in chosen and name in rows["phenomena"][k]:
                    chosen.append(k)
                    have += 1
        chosen += [k for k in rows.index if k not in chosen][: max(0, take - len(chosen))]
        return rows.loc[chosen][[article, "claim_id", "risk"]]

    kind = dict(claims.dtypes)
    return claims.groupBy(article).applyInPandas(pick, f"{article} {kind[article]}, claim_id {kind['claim_id']}, risk double")
