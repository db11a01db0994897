"""Text diagnostics: sentence statistics, duplicate sentences, near-duplicate paragraphs, argument structure."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def article_diagnostics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Words, sentences, mean / p90 / variation of sentence length and duplicate-sentence rate per document; no explode, no shuffle."""
    rows = docs.select(key, sentences(F.coalesce(text, F.lit(""))).alias("s"), F.size(words(F.coalesce(text, F.lit("")))).alias("words"))
    rows = rows.withColumn("n", F.size("s")).withColumn("len", F.array_sort(F.transform("s", lambda s: F.size(words(s)).cast("double"))))
    mean = F.aggregate("len", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    rows = rows.withColumn("mean", F.when(F.col("n") > 0, mean).otherwise(0.0))
    variance = F.aggregate("len", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.col("n")
    at = 0.9 * (F.col("n") - 1)
    low = F.get("len", F.floor(at).cast("int"))
    high = F.get("len", F.ceil(at).cast("int"))
    return rows.select(
        key, F.col("words").cast("long").alias("words"), F.col("n").cast("long").alias("sentences"), F.round("mean", 6).alias("mean_length"),
        F.round(F.when(F.col("n") > 0, low + (high - low) * (at - F.floor(at))).otherwise(0.0), 6).alias("p90_length"),
        F.round(F.when(F.col("mean") > 0, F.sqrt(variance) / F.col("mean")).otherwise(0.0), 6).alias("variation"),
        F.round(F.when(F.col("n") > 0, 1 - F.size(F.array_distinct(F.transform("s", F.lower))) / F.col("n")).otherwise(0.0), 6).alias("duplicate_rate"),
    )


def paragraphs(docs: DataFrame, key: str, text: str, separator: str = "\n") -> DataFrame:
    """(key, paragraph, start, body): non-blank paragraphs with their code-point offsets."""
    parts = docs.select(key, F.split(F.coalesce(text, F.lit("")), separator).alias("p"))
    starts = F.aggregate("p", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + len(separator))))
    rows = parts.select(key, F.posexplode(F.arrays_zip(F.col("p").alias("body"), F.slice(starts, 1, F.size("p")).alias("start"))).alias("paragraph", "z"))
    return rows.select(key, "paragraph", F.col("z.start").alias("start"), F.col("z.body").alias("body")).filter(F.trim("body") != "")


def _similar_sets(sets: dict[int, frozenset], least: float) -> list[tuple[int, int, float]]:
    """(left, right, similarity) of one document; equal sets are compared once, others on shingles of their rarest."""
    classes: dict[frozenset, list[int]] = {}
    for k, s in sorted(sets.items()):
        classes.setdefault(s, []).append(k)
    out = [(a, b, 1.0) for own in classes.values() for i, a in enumerate(own) for b in own[i + 1 :]]
    held = Counter(g for s in classes for g in s)
    index: dict[str, list[frozenset]] = {}
    for s in sorted(classes, key=len):
        n, seen = len(s), set()
        shared = sorted((held[g], g) for g in s if held[g] > 1)
        # Of a set's shingles, partners miss at most n - ceil(least n); those that it holds alone are missed for sure.
        for _, g in shared[: max(0, len(shared) - math.ceil(least * n - 1e-9) + 1)]:
            for other in index.get(g, ()):
                if other not in seen and len(other) >= least * n - 1e-9:
                    seen.add(other)
                    both = len(s & other)
                    similarity = both / (n + len(other) - both)
                    if similarity >= least:
                        out += [(min(a, b), max(a, b), similarity) for a in classes[s] for b in classes[other]]
            index.setdefault(g, []).append(s)
    return out


def near_duplicate_paragraphs(rows: DataFrame, group: str, ident: str, text: str, size: int = 5, least: float = 0.8) -> DataFrame:
    """Pairs of paragraphs of one document with Jaccard similarity of word shingles of at least ``least``.

    Paragraphs go to their document's task once, as words; no shingle is shuffled. Rows with one ``ident`` of a
    ``group`` are one paragraph; a null group has no pairs.
    """

    def pairs(batches):
        import pandas as pd

        now, sets = None, {}

        def solved():
            return [(now, a, b, s) for a, b, s in _similar_sets({k: frozenset(v) for k, v in sets.items()}, least)] if len(sets) > 1 else []

        for batch in batches:
            out = []
            for g, k, body in zip(batch[group], batch[ident], batch["w"], strict=True):
                if g != now:
                    out += solved()
                    now, sets = g, {}
                w = body.split(" ")
                sets.setdefault(k, set()).update(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))
            yield pd.DataFrame(out, columns=[group, "left", "right", "similarity"])
        yield pd.DataFrame(solved(), columns=[group, "left", "right", "similarity"])

    body = F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " "))
    sent = rows.select(group, ident, body.alias("w")).filter(F.col(group).isNotNull() & (F.col("w") != "")).repartition(group).sortWithinPartitions(group)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (group, ident)}
    found = sent.mapInPandas(pairs, f"`{group}` {kinds[group]}, left {kinds[ident]}, right {kinds[ident]}, similarity double")
    return found.select(group, "left", "right", F.round("similarity", 6).alias("similarity"))


def section_entropy(rows: DataFrame, key: str, section: str, size: str) -> DataFrame:
    """Normalized entropy of the words' distribution over sections."""
    sums = rows.groupBy(key, section).agg(F.sum(size).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    out = sums.withColumn("p", share).groupBy(key).agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0)).alias("h"), F.count(F.lit(1)).alias("k"))
    return out.select(key, F.when(F.col("k") > 1, F.col("h") / F.log("k")).otherwise(0.0).alias("entropy"))


def opening_repeats(docs: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """Share of sentences whose first words open another sentence of the same document."""
    opened = F.transform(sentences(F.coalesce(text, F.lit(""))), lambda s: F.array_join(F.slice(words(s), 1, size), " "))
    rows = docs.select(key, opened.alias("o"))
    return rows.select(key, F.when(F.size("o") > 0, 1 - F.size(F.array_distinct("o")) / F.size("o")).otherwise(0.0).alias("repeat_rate"))


def summarize(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, mean, median) in one pass."""
    once = rows.agg(*[F.struct(F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median")).alias(c) for c in columns])
    return once.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.median").alias("median")) for c in columns])))
