"""The driver's tables in the roles of the canonical model."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Corpus:
    """Canonical tables over a folder of Parquet tables; everything is lazy and column-pruned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def works(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("work_id"), F.year("o_orderdate").cast("long").alias("year"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("cited_by_count"),
            F.col("o_orderpriority").alias("document_type"), F.col("o_orderstatus").alias("language"), F.col("o_custkey").alias("source_id"),
        )

    @cached_property
    def authorships(self) -> DataFrame:
        nation = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("institution_id"))
        return self.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(nation, "l_suppkey", "left").select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("author_id"), "institution_id", F.col("l_linenumber").cast("long").alias("position"))

    @cached_property
    def keywords(self) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("keyword"), F.col("p_brand").alias("keyword_type"))
        return self.table("lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").select(F.col("l_orderkey").alias("work_id"), "keyword", "keyword_type")

    @cached_property
    def references(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("citing_work_id"), F.col("l_partkey").alias("cited_work_id"))

    @cached_property
    def memberships(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_partkey").alias("item"))

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")


#: The same views for DuckDB.
VIEWS = """
works AS (SELECT o_orderkey AS work_id, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(floor(o_totalprice / 1000) AS BIGINT) AS cited_by_count,
  o_orderpriority AS document_type, o_orderstatus AS language, o_custkey AS source_id FROM orders),
authorships AS (SELECT l_orderkey AS work_id, l_suppkey AS author_id, CAST(s_nationkey AS BIGINT) AS institution_id, CAST(l_linenumber AS BIGINT) AS position
  FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey),
keywords AS (SELECT l_orderkey AS work_id, p_type AS keyword, p_brand AS keyword_type FROM lineitem JOIN part ON p_partkey = l_partkey),
refs AS (SELECT l_orderkey AS citing_work_id, l_partkey AS cited_work_id FROM lineitem),
memberships AS (SELECT l_orderkey AS work_id, l_partkey AS item FROM lineitem)"""
