"""Corpus aggregates: productivity tables, quantiles, trends, coverage and quality counts.

All functions take DataFrames in the canonical column names (``work_id``, ``year``,
``cited_by_count`` ...) and stay declarative, so that partial aggregation runs beside the
scan and only group rows are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(text: Column) -> Column:
    """Non-blank predicate; null is not filled."""
    return F.trim(text) != ""


def annual_output(works: DataFrame) -> DataFrame:
    cites = F.coalesce("cited_by_count", F.lit(0))
    return works.filter("year IS NOT NULL").groupBy("year").agg(F.count(F.lit(1)).alias("works"), F.sum(cites).alias("citations"), F.avg(cites).alias("mean_citations"))


def raw_group_counts(works: DataFrame, column: str, label: str = "Unknown") -> DataFrame:
    """Counts by the raw value; only the shown label fills nulls, so a literal label stays apart."""
    return works.groupBy(column).agg(F.count(F.lit(1)).alias("works")).select(F.coalesce(F.col(column).cast("string"), F.lit(label)).alias(column), "works")


def entity_productivity(works: DataFrame, links: DataFrame, entity: str, names: DataFrame | None = None) -> DataFrame:
    """Distinct works and summed citations of each entity over distinct (work, entity) links.

    ``names`` (entity, name) is looked up by a left join; Spark broadcasts it where its size allows.
    """
    pairs = links.filter(F.col(entity).isNotNull()).select("work_id", entity).distinct()
    rows = pairs.join(works.select("work_id", "cited_by_count"), "work_id")
    out = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("works"), F.sum(F.coalesce("cited_by_count", F.lit(0))).alias("citations"))
    return out.join(names, entity, "left") if names is not None else out


def term_occurrences(memberships: DataFrame, *terms: str) -> DataFrame:
    return memberships.filter(filled(F.col(terms[0]).cast("string"))).groupBy(*terms).agg(F.countDistinct("work_id").alias("works"))


def reference_impact(references: DataFrame, attributes: list[str]) -> DataFrame:
    """Distinct citing works of each cited work, with the largest value of each attribute."""
    return references.groupBy("cited_work_id").agg(F.countDistinct("citing_work_id").alias("local_citations"), *[F.max(a).alias(a) for a in attributes])


def count_table(frame: DataFrame, key: str, limit: int) -> DataFrame:
    """The largest groups, the null group included; ties by key, nulls last."""
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.col(key).asc_nulls_last()).limit(limit)


def citation_quantiles(works: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, exact interpolated quantiles, maximum and zero count of citations."""
    c = F.coalesce(F.col("cited_by_count"), F.lit(0))
    stats = [F.avg(c).alias("mean"), F.max(c).alias("maximum"), F.count_if(c == 0).alias("uncited")]
    stats += [F.percentile(c, q).alias(n) for n, q in (("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p98", 0.98))]
    return works.groupBy(*(by or [])).agg(*stats)


def top_terms(memberships: DataFrame, term: str, k: int) -> DataFrame:
    return memberships.groupBy(term).agg(F.countDistinct("work_id").alias("total")).orderBy(F.desc("total"), term).limit(k)


def term_trend(works: DataFrame, memberships: DataFrame, term: str, k: int = 15) -> DataFrame:
    """Distinct works by (term, year) of the k most frequent terms; the k rows are broadcast."""
    top = F.broadcast(top_terms(memberships, term, k).select(term))
    rows = memberships.join(top, term).join(works.filter("year IS NOT NULL").select("work_id", "year"), "work_id")
    return rows.groupBy(term, "year").agg(F.countDistinct("work_id").alias("works"))


def corpus_summary(works: DataFrame) -> DataFrame:
    """Scalars and the compound annual growth rate in percent between the first and last year."""
    years = works.filter("year IS NOT NULL").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("cited_by_count", F.lit(0))).alias("c"))
    total = years.agg(F.sum("n").alias("works"), F.sum("c").alias("citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("n", "year").alias("n0"), F.max_by("n", "year").alias("n1"))
    span = F.col("last_year") - F.col("first_year")
    growth = F.when((span > 0) & (F.col("n0") > 0), (F.pow(F.col("n1") / F.col("n0"), 1 / span) - 1) * 100)
    return total.select("works", "citations", "first_year", "last_year", growth.alias("cagr"))


def field_coverage(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(field, present, missing, ratio) in one pass; blank strings count as missing."""
    kinds = dict(frame.dtypes)
    present = [F.count_if(filled(F.col(c)) if kinds[c] == "string" else F.col(c).isNotNull()).alias(c) for c in columns]
    once = frame.agg(F.count(F.lit(1)).alias("__n"), *present)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in columns])
    rows = once.select("__n", F.inline(pairs))
    return rows.select("field", "present", (F.col("__n") - F.col("present")).alias("missing"), F.when(F.col("__n") > 0, F.col("present") / F.col("__n")).otherwise(0.0).alias("ratio"))


def readiness(coverage: DataFrame) -> DataFrame:
    """Readiness of each field by its coverage: ready, usable, limited, weak or absent (0.8, 0.5, 0.3, 0.1)."""
    level = F.when(F.col("ratio") >= 0.8, "ready").when(F.col("ratio") >= 0.5, "usable").when(F.col("ratio") >= 0.3, "limited").when(F.col("ratio") >= 0.1, "weak").otherwise("absent")
    return coverage.select("field", "ratio", level.alias("level"))


def key_uniqueness(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys (nulls included) and their difference."""
    once = frame.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.struct(*keys)).alias("distinct_keys"))
    return once.withColumn("duplicates", F.col("rows") - F.col("distinct_keys"))


def pair_mass(memberships: DataFrame, group: str, item: str) -> DataFrame:
    """Sum over groups of n (n - 1) / 2 for the n distinct items of a group."""
    sizes = memberships.groupBy(group).agg(F.countDistinct(item).alias("n"))
    return sizes.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pair_mass"), F.count(F.lit(1)).alias("groups"))


def average_year(works: DataFrame, memberships: DataFrame, term: str) -> DataFrame:
    rows = memberships.select("work_id", term).distinct().join(works.filter("year IS NOT NULL").select("work_id", "year"), "work_id")
    return rows.groupBy(term).agg(F.avg("year").alias("average_year"), F.count(F.lit(1)).alias("works"))


def ordered_strings(frame: DataFrame, key: str, value: str, position: str | None = None, separator: str = "; ") -> DataFrame:
    """Distinct values of each key in one string, by first position if given, else by value."""
    text = F.col(value).cast("string")
    held = frame.filter(text.isNotNull())
    if position is None:
        return held.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(text)), separator).alias(value))
    first = held.groupBy(key, text.alias(value)).agg(F.min(position).alias("__at"))
    listed = F.array_sort(F.collect_list(F.struct("__at", value)))
    return first.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s[value]), separator).alias(value))


def term_year_matrix(trend: DataFrame, term: str, years: list[int]) -> DataFrame:
    """Dense term x year table, zero filled; stating the years spares a pass over the data."""
    return trend.groupBy(term).pivot("year", years).agg(F.sum("works")).na.fill(0)


def other_rollup(counts: DataFrame, label: str, value: str, keep: int = 7) -> DataFrame:
    """The ``keep`` largest groups and the rest as 'Other'; the top rows are few and broadcast."""
    top = F.broadcast(counts.orderBy(F.desc(value), label).limit(keep).select(F.col(label).alias("__top")))
    shown = F.when(F.col("__top").isNull(), "Other").otherwise(F.col(label).cast("string"))
    return counts.join(top, F.col(label) == F.col("__top"), "left").groupBy(shown.alias(label)).agg(F.sum(value).alias(value))


def three_field(authorships: DataFrame, works: DataFrame, memberships: DataFrame, limits: tuple[int, int, int] = (8, 8, 10)) -> DataFrame:
    """Works by (author, source, keyword) among the most frequent of each; three short broadcast lists."""
    authors = F.broadcast(top_terms(authorships, "author_id", limits[0]).select("author_id"))
    sources = F.broadcast(top_terms(works.filter("source_id IS NOT NULL"), "source_id", limits[1]).select("source_id"))
    terms = F.broadcast(top_terms(memberships, "keyword", limits[2]).select("keyword"))
    left = authorships.select("work_id", "author_id").distinct().join(authors, "author_id")
    middle = works.select("work_id", "source_id").join(sources, "source_id")
    right = memberships.select("work_id", "keyword").distinct().join(terms, "keyword")
    rows = left.join(middle, "work_id").join(right, "work_id")
    return rows.groupBy("author_id", "source_id", "keyword").agg(F.countDistinct("work_id").alias("works"))


def marginals(flows: DataFrame, columns: list[str], value: str) -> DataFrame:
    """(field, label, total) of every column's values in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("label")) for c in columns]))
    return flows.select(pairs.alias("p"), value).groupBy("p.field", "p.label").agg(F.sum(value).alias("total"))


def identity_damage(links: DataFrame, entity: str, bad: Column) -> DataFrame:
    return links.filter(bad).groupBy(entity).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("work_id").alias("works"))


def condition_metrics(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Count and the rate of each 0/1 flag by group."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c.cast("double")).alias(k) for k, c in flags.items()])


def scale_tier(works: DataFrame, limits: tuple[int, ...] = (5_000, 50_000, 500_000)) -> DataFrame:
    names = ("small", "medium", "large", "very_large")
    n = F.col("works")
    tier = reduce(lambda acc, k: F.when(n < limits[k], names[k]).otherwise(acc), reversed(range(len(limits))), F.lit(names[-1]))
    return works.agg(F.count(F.lit(1)).alias("works")).select("works", tier.alias("tier"))


def bradford(counts: DataFrame, entity: str, value: str = "works", rule: str = "floor") -> DataFrame:
    """Bradford zones by running sums over the ranking (value desc, entity).

    ``floor``: floor((cumulative - 1) / max(total / 3, 1)) + 1, at most 3; ``ceil``: ceil(cumulative /
    (total / 3)) within 1..3; ``tied``: equal values share their cumulative sum, floor(3 (cumulative - 1) / total) + 1.
    The running sum needs one ordered pass; it runs over one row per entity, after aggregation.
    """
    order = Window.orderBy(F.desc(value), entity).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if rule == "tied":
        order = Window.orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(value).over(Window.partitionBy())
    rows = counts.select(entity, value, F.sum(value).over(order).alias("cumulative"), total.alias("total"))
    if rule == "ceil":
        zone = F.least(F.greatest(F.ceil(F.col("cumulative") / (F.col("total") / 3.0)), F.lit(1)), F.lit(3))
    elif rule == "tied":
        zone = F.least(F.floor(3.0 * (F.col("cumulative") - 1) / F.col("total")) + 1, F.lit(3))
    else:
        zone = F.least(F.floor((F.col("cumulative") - 1) / F.greatest(F.col("total") / 3.0, F.lit(1.0))) + 1, F.lit(3))
    return rows.select(entity, value, "cumulative", zone.cast("long").alias("zone"))
