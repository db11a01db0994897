"""Acquisition planning: query text, date slices, the record ledger. Transport is left to the caller."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Request parameters of the public APIs.
ADAPTERS = {
    "crossref": {"rows": 1000, "cursor": "cursor", "first": "*", "total": "message.total-results", "items": "message.items", "next": "message.next-cursor", "identity": "DOI"},
    "openalex": {"rows": 100, "cursor": "cursor", "first": "*", "total": "meta.count", "items": "results", "next": "meta.next_cursor", "identity": "id"},
    "europe_pmc": {"rows": 1000, "cursor": "cursorMark", "first": "*", "total": "hitCount", "items": "resultList.result", "next": "nextCursorMark", "identity": "id"},
}


@dataclass(frozen=True)
class Slice:
    first: date
    last: date
    expected: int


def query_text(terms: list[str], mode: str = "all") -> str:
    quoted = [f'"{t}"' if " " in t else t for t in terms]
    return f'"{" ".join(terms)}"' if mode == "phrase" else (" OR " if mode == "any" else " AND ").join(quoted)


def plan_slices(daily: DataFrame, first: date, last: date, target: int) -> list[Slice]:
    """Date ranges by bisection until each expects at most ``target`` records or is one day.

    ``daily`` has (day, n), one row a day, so its prefix sums fit the driver.
    """
    counts = {r["day"]: r["n"] for r in daily.filter(F.col("day").between(F.lit(first), F.lit(last))).select("day", "n").collect()}
    prefix, total, day = {}, 0, first
    while day <= last:
        prefix[day] = total
        total += counts.get(day, 0)
        day += timedelta(1)
    prefix[last + timedelta(1)] = total

    def split(a: date, b: date) -> list[Slice]:
        n = prefix[b + timedelta(1)] - prefix[a]
        if n <= target or a == b:
            return [Slice(a, b, n)]
        mid = a + (b - a) // 2
        return split(a, mid) + split(mid + timedelta(1), b)

    return split(first, last) if first <= last else []


def cumulative_slices(records: DataFrame, day: str, target: int) -> DataFrame:
    """The same idea in one plan: consecutive days share a slice until ``target`` is passed; ordered over one row a day."""
    daily = records.groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = daily.withColumn("slice", F.floor(before / target))
    return part.groupBy("slice").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("expected"))


def year_slices(records: DataFrame, year: str) -> DataFrame:
    return records.groupBy(year).agg(F.count(F.lit(1)).alias("expected"))


def record_ledger(staged: DataFrame, identity: str, order: list[str]) -> DataFrame:
    """The first occurrence of each record id by (slice, page, position); the rest marked as duplicates."""
    rank = F.row_number().over(Window.partitionBy(identity).orderBy(*order))
    return staged.withColumn("first", rank == 1)


def harvest_profile(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Received, distinct and expected records of each slice, and whether it is complete; ``pages``: slice, record_id."""
    got = pages.groupBy("slice").agg(F.count(F.lit(1)).alias("received"), F.countDistinct("record_id").alias("distinct_records"))
    return expected.select("slice", "expected").join(got, "slice", "left").na.fill(0, ["received", "distinct_records"]).withColumn("complete", F.col("distinct_records") >= F.col("expected"))
