"""Joins by parameter lists, strict pairings, reuse by content, network facts and the count benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolved(references: DataFrame, column: str) -> DataFrame:
    """References that name a known work: neither null nor a ``reference:`` stand-in."""
    return references.filter(F.col(column).isNotNull() & ~F.startswith(F.col(column), F.lit("reference:")))


def listed(rows: DataFrame, column: str, values: list, inline: int = 1000) -> DataFrame:
    """Rows whose ``column`` is one of ``values``; short lists reach the scan as a filter, long ones are a semi-join."""
    wanted = sorted({v for v in values if v is not None})
    if len(wanted) <= inline:
        return rows.filter(F.col(column).isin(wanted))
    kind = rows.schema[column].dataType.simpleString()
    return rows.join(rows.sparkSession.createDataFrame([(v,) for v in wanted], f"__value {kind}"), F.col(column) == F.col("__value"), "left_semi")


def in_file_order(rows: DataFrame) -> DataFrame:
    """Rows of a single-file scan with ``row_index``, their place in the file; a shuffle keeps no order, the column does."""
    return rows.select("*", F.col("_metadata.row_index").alias("row_index"))


def family_rates(rows: DataFrame, family: str, held: Column) -> DataFrame:
    """n and rate of each family, and which has the least rate (the first by name of equals)."""
    rates = rows.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(held, 1.0).otherwise(0.0)).alias("rate"))
    worst = rates.agg(F.min_by(family, F.struct(F.round("rate", 12), family)).alias("worst"))
    return rates.crossJoin(F.broadcast(worst)).withColumn("weakest", F.col(family) == F.col("worst")).drop("worst")


def paired(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both conditions side by side; a key that one of them lacks or repeats is an error when the rows are read."""
    a = first.withColumn("__a", F.lit(1)).join(second.withColumn("__b", F.lit(1)), keys, "full")
    complete = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unpaired: "), F.concat_ws("/", *keys))).cast("boolean"))
    return a.filter(complete).drop("__a", "__b")


def exact_reuse(wanted: DataFrame, encoded: DataFrame, text: str) -> DataFrame:
    """The wanted rows with ``reused``: whether an equal text has been encoded. Only digests are shuffled beside them."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    known = encoded.select(digest.alias("__digest")).distinct().withColumn("__known", F.lit(True))
    return wanted.withColumn("__digest", digest).join(known, "__digest", "left").withColumn("reused", F.coalesce("__known", F.lit(False))).drop("__digest", "__known")


def network_facts(edges: DataFrame) -> DataFrame:
    """One row: sizes, the hub (most neighbours, then the least id) and the strongest edge (then the least ids)."""
    ends = edges.select(F.col("source").alias("node")).unionAll(edges.select(F.col("target").alias("node")))
    degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    hub = degrees.agg(F.count(F.lit(1)).alias("nodes"), F.min_by("node", F.struct(-F.col("degree"), "node")).alias("hub"), F.max("degree").alias("hub_degree"))
    order = F.struct(-F.col("weight"), "source", "target")
    best = edges.agg(F.count(F.lit(1)).alias("edges"), F.min_by("source", order).alias("strongest_source"), F.min_by("target", order).alias("strongest_target"), F.max("weight").alias("strongest_weight"))
    return hub.crossJoin(F.broadcast(best))


def count_benchmark(spark: SparkSession, documents: int, terms: int, kinds: int, top: int) -> DataFrame:
    """Generated memberships, ``terms`` of each document, and the ``top`` terms by distinct documents.

    Integer division is spelled out: a cast of the quotient would truncate here and round elsewhere.
    """
    rows = spark.range(0, documents * terms).select(F.expr(f"id div {terms}").alias("doc"), F.expr(f"(id div {terms} * 7 + id % {terms} * 13) % {kinds}").alias("term"))
    return rows.groupBy("term").agg(F.countDistinct("doc").alias("documents")).orderBy(F.desc("documents"), "term").limit(top)
