"""Sinks: Parquet, JSON lines, CSV, VOSviewer and bibliometrix exports, file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.operators.aggregates import ordered_strings


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as zstd Parquet; Spark's commit protocol makes a table appear whole or not at all."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.option("mergeSchema", "true").parquet(f"{folder}/{n}") for n in names}


def write_jsonl(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def vosviewer(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(map, network): dense ids by (occurrences desc, id); self links and unknown ends are dropped.

    ``nodes``: id, label, occurrences, cluster of a displayed, so bounded, network.
    """
    ranked = nodes.select("id", "label", "occurrences", "cluster", F.row_number().over(Window.orderBy(F.desc("occurrences"), "id")).cast("long").alias("number"))
    ids = ranked.select(F.col("id").alias("__id"), "number")
    a, b = F.broadcast(ids.toDF("source", "na")), F.broadcast(ids.toDF("target", "nb"))
    rows = edges.filter("source <> target").join(a, "source").join(b, "target")
    network = rows.select(F.least("na", "nb").alias("first"), F.greatest("na", "nb").alias("second"), "weight")
    return ranked.select(F.col("number").alias("id"), "label", F.col("occurrences").alias("weight<Occurrences>"), "cluster"), network


def bibliometrix(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a work with '; '-joined authors, affiliations, keywords, topics and references, authors by position."""
    people = tables["authorships"].join(tables["authors"].select("author_id", F.col("name").alias("AU")), "author_id", "left")
    places = tables["authorships"].join(tables["institutions"].select("institution_id", F.col("name").alias("C1")), "institution_id", "left")
    cited = tables["references"].select(F.col("citing_work_id").alias("work_id"), F.coalesce("cited_title", "cited_doi", "cited_work_id").alias("CR"))
    out = tables["works"].join(tables["sources"].select("source_id", F.col("name").alias("SO")), "source_id", "left")
    out = out.select("work_id", F.col("title").alias("TI"), F.col("abstract").alias("AB"), F.col("year").alias("PY"), "SO", F.col("doi").alias("DI"), F.col("cited_by_count").alias("TC"), F.col("document_type").alias("DT"))
    joined = (
        ordered_strings(people, "work_id", "AU", "position"),
        ordered_strings(places, "work_id", "C1", "position"),
        ordered_strings(tables["keywords"].withColumnRenamed("keyword", "DE"), "work_id", "DE"),
        ordered_strings(tables["topics"].withColumnRenamed("topic", "WC"), "work_id", "WC"),
        ordered_strings(cited, "work_id", "CR"),
    )
    for part in joined:
        out = out.join(part, "work_id", "left")
    return out


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, read on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
