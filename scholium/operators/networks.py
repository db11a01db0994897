"""Bounded co-occurrence, citation, co-citation and coupling networks.

Pair expansion is quadratic in a group's size, so it always follows a stated reduction:
candidates by occurrence (top k, broadcast), a cap on a group's items, or a range of
informative references. Pairs are made inside a group's sorted item array, so a group is
expanded where it lies and no self-join shuffles memberships twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(memberships: DataFrame, group: str, item: str, pool: int, least: int = 1) -> DataFrame:
    """The ``pool`` items in most groups, ties by item."""
    counts = memberships.groupBy(item).agg(F.countDistinct(group).alias("occurrences")).filter(F.col("occurrences") >= least)
    return counts.orderBy(F.desc("occurrences"), item).limit(pool)


def group_pairs(memberships: DataFrame, group: str, item: str) -> DataFrame:
    """(source, target, weight): groups that hold both items, source < target."""
    items = memberships.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("xs")).filter(F.size("xs") > 1)
    pairs = F.expr("flatten(transform(slice(xs, 1, size(xs) - 1), (a, i) -> transform(slice(xs, i + 2, size(xs)), b -> struct(a AS source, b AS target))))")
    return items.select(F.inline(pairs)).groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def cooccurrence(memberships: DataFrame, group: str, item: str, pool: int = 500, edge_limit: int = 200_000, least: int = 1) -> DataFrame:
    """Edges among the ``pool`` most frequent items, heaviest first."""
    top = F.broadcast(candidates(memberships, group, item, pool, least).select(item))
    pairs = group_pairs(memberships.select(group, item).join(top, item), group, item)
    return pairs.orderBy(F.desc("weight"), "source", "target").limit(edge_limit)


def capped(memberships: DataFrame, group: str, item: str, cap: int) -> DataFrame:
    """At most ``cap`` items of each group, those in most groups first; the cap is the feature."""
    rows = memberships.select(group, item).distinct()
    counts = rows.groupBy(item).agg(F.count(F.lit(1)).alias("occurrences"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("occurrences"), item))
    return rows.join(counts, item).withColumn("rank", rank).filter(F.col("rank") <= cap).drop("rank")


def pair_network(memberships: DataFrame, group: str, item: str, pool: int, cap: int, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): distinct memberships, minimum occurrence, pool, group cap, association strength w / (o1 o2)."""
    nodes = candidates(memberships, group, item, pool, least)
    kept = memberships.select(group, item).distinct().join(F.broadcast(nodes), item)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("occurrences"), item))
    kept = kept.withColumn("rank", rank).filter(F.col("rank") <= cap)
    return nodes, association(group_pairs(kept, group, item), nodes, item)


def association(edges: DataFrame, nodes: DataFrame, item: str, floor: int = 1) -> DataFrame:
    """Edges with weight / (occurrences of both ends), occurrences at least ``floor``."""
    held = nodes.select(F.col(item), F.greatest("occurrences", F.lit(floor)).alias("o"))
    a, b = held.select(F.col(item).alias("source"), F.col("o").alias("oa")), held.select(F.col(item).alias("target"), F.col("o").alias("ob"))
    return edges.join(F.broadcast(a), "source").join(F.broadcast(b), "target").select("source", "target", "weight", (F.col("weight") / (F.col("oa") * F.col("ob"))).alias("association_strength"))


def direct_citations(references: DataFrame, cited: DataFrame, edge_limit: int = 200_000) -> DataFrame:
    """Citation pairs restricted to cited works of the corpus."""
    return references.select("citing_work_id", "cited_work_id").join(cited.select("cited_work_id").distinct(), "cited_work_id").groupBy("citing_work_id", "cited_work_id").agg(F.count(F.lit(1)).alias("weight")).orderBy("citing_work_id", "cited_work_id").limit(edge_limit)


def citation_network(references: DataFrame, works: DataFrame, pool: int) -> DataFrame:
    """Within-corpus citations among the ``pool`` most cited works that have a link at all."""
    ids = works.select(F.col("work_id"), "cited_by_count")
    inner = references.select(F.col("citing_work_id").alias("source"), F.col("cited_work_id").alias("target")).filter("source <> target").distinct()
    inner = inner.join(ids.select(F.col("work_id").alias("source")), "source", "left_semi").join(ids.select(F.col("work_id").alias("target")), "target", "left_semi")
    linked = endpoints(inner)
    top = F.broadcast(ids.join(linked, ids["work_id"] == linked["node"], "left_semi").orderBy(F.col("cited_by_count").desc_nulls_last(), "work_id").limit(pool).select("work_id"))
    return inner.join(top.withColumnRenamed("work_id", "source"), "source", "left_semi").join(top.withColumnRenamed("work_id", "target"), "target", "left_semi")


def scalable_coupling(references: DataFrame, works: DataFrame, pool: int = 500, least_references: int = 5, share: float = 0.2, least_shared: int = 2) -> DataFrame:
    """Bibliographic coupling of the best candidates over informative references only.

    Candidates have at least ``least_references`` references and the highest ln(1 + citations) +
    0.35 ln(1 + references); a reference is informative if 2 .. max(10, ceil(share x candidates)) candidates cite it.
    """
    refs = references.select("citing_work_id", "cited_work_id").distinct()
    sizes = refs.groupBy("citing_work_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_references)
    rows = sizes.join(works.select(F.col("work_id").alias("citing_work_id"), "cited_by_count"), "citing_work_id")
    score = F.round(F.log1p(F.coalesce(F.col("cited_by_count"), F.lit(0)).cast("double")) + 0.35 * F.log1p(F.col("n").cast("double")), 9)
    top = rows.withColumn("score", score).orderBy(F.desc("score"), "citing_work_id").limit(pool).select("citing_work_id")
    kept = refs.join(F.broadcast(top), "citing_work_id")
    counted = top.agg(F.greatest(F.lit(10), F.ceil(F.count(F.lit(1)) * share)).alias("most"))
    informative = kept.groupBy("cited_work_id").agg(F.count(F.lit(1)).alias("df")).filter("df >= 2").crossJoin(F.broadcast(counted)).filter("df <= most").select("cited_work_id")
    return group_pairs(kept.join(informative, "cited_work_id"), "cited_work_id", "citing_work_id").filter(F.col("weight") >= least_shared)


def endpoints(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    return edges.select(F.col(source).alias("node")).union(edges.select(F.col(target).alias("node"))).distinct()


def linked_nodes(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Only nodes at the end of some edge."""
    ends = endpoints(edges)
    return nodes.join(ends, nodes[key] == ends["node"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """Degree and weighted degree of every endpoint of undirected edges."""
    both = edges.select(F.explode(F.array("source", "target")).alias("node"), "weight")
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))


def strongest_edges(edges: DataFrame, per_node: int) -> DataFrame:
    """Edges among the ``per_node`` heaviest of either end."""
    ends = F.explode(F.array("source", "target")).alias("node")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "source", "target"))
    return edges.select("source", "target", "weight", ends).withColumn("rank", rank).filter(F.col("rank") <= per_node).select("source", "target", "weight").distinct()


def density(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes, edges, isolates and density of an undirected graph."""
    linked = linked_nodes(nodes, edges, key).agg(F.count(F.lit(1)).alias("linked"))
    size = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(linked)
    pairs = F.col("nodes") * (F.col("nodes") - 1) / 2
    return size.select("nodes", "edges", (F.col("nodes") - F.col("linked")).alias("isolates"), F.when(F.col("nodes") > 1, F.col("edges") / pairs).otherwise(0.0).alias("density"))


def community_boundaries(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Internal and external weight and edges of each community; ``labels`` has (node, community)."""
    a, b = labels.select(F.col("node").alias("source"), F.col("community").alias("ca")), labels.select(F.col("node").alias("target"), F.col("community").alias("cb"))
    rows = edges.join(a, "source").join(b, "target")
    ends = F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community")
    inner = F.col("ca") == F.col("cb")
    rows = rows.select("weight", inner.alias("inner"), ends)
    out = rows.groupBy("community").agg(
        F.sum(F.when(F.col("inner"), F.col("weight")).otherwise(0)).alias("internal_weight"),
        F.sum(F.when(~F.col("inner"), F.col("weight")).otherwise(0)).alias("external_weight"),
        F.count_if("inner").alias("internal_edges"),
        F.count_if(~F.col("inner")).alias("external_edges"),
    )
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("members"))
    out = sizes.join(out, "community", "left").na.fill(0)
    total = F.col("internal_weight") + F.col("external_weight")
    return out.withColumn("external_share", F.when(total > 0, F.col("external_weight") / total).otherwise(0.0))


def thematic_map(boundaries: DataFrame) -> DataFrame:
    """Density and centrality of communities and their quadrant by the medians of both."""
    n = F.col("members")
    rows = boundaries.select("community", "members", F.when(n > 1, F.col("internal_weight") / (n * (n - 1) / 2)).otherwise(0.0).alias("density"), (F.col("external_weight") / n).alias("centrality"))
    middle = rows.agg(F.percentile("density", 0.5).alias("md"), F.percentile("centrality", 0.5).alias("mc"))
    high_d, high_c = F.col("density") >= F.col("md"), F.col("centrality") >= F.col("mc")
    quadrant = F.when(high_d & high_c, "motor").when(high_d, "niche").when(high_c, "basic").otherwise("emerging_or_declining")
    return rows.crossJoin(F.broadcast(middle)).select("community", "members", "density", "centrality", quadrant.alias("quadrant"))


def percentile_rank(frame: DataFrame, column: str, name: str) -> DataFrame:
    """Rank over n, ties at their average rank. Ranks come from counts of values, so only distinct values are ordered in one task."""
    values = frame.groupBy(column).agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    n = F.sum("__c").over(Window.partitionBy())
    ranks = values.select(F.col(column).alias("__v"), ((F.coalesce(before, F.lit(0)) + (F.col("__c") + 1) / 2) / n).alias(name))
    return frame.join(ranks, frame[column] == ranks["__v"]).drop("__v")


def perturb_edges(edges: DataFrame, least_weight: float = 0, dropout: float = 0.0, seed: int = 42) -> DataFrame:
    """Edges of at least a weight, less the first floor(share x edges) by a hash of seed and ends."""
    kept = edges.filter(F.col("weight") >= least_weight)
    if not dropout:
        return kept
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("source").cast("string"), F.col("target").cast("string")), 256)
    gone = int(kept.count() * dropout)
    dropped = kept.select("source", "target", key.alias("k")).orderBy("k", "source", "target").limit(gone).select("source", "target")
    return kept.join(dropped, ["source", "target"], "left_anti")


def knowledge_graph(works: DataFrame, authorships: DataFrame, memberships: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): works, authors, sources, keywords and cited works with five relations."""

    def ident(kind: str, c: str):
        return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    def node(df: DataFrame, kind: str, c: str) -> DataFrame:
        return df.filter(F.col(c).isNotNull()).select(ident(kind, c).alias("id"), F.lit(kind).alias("kind")).distinct()

    def edge(df: DataFrame, a: str, ca: str, b: str, cb: str, relation: str) -> DataFrame:
        return df.filter(F.col(ca).isNotNull() & F.col(cb).isNotNull()).select(ident(a, ca).alias("src"), ident(b, cb).alias("dst"), F.lit(relation).alias("relation")).distinct()

    nodes = node(works, "work", "work_id").union(node(authorships, "author", "author_id")).union(node(works, "source", "source_id")).union(node(memberships, "keyword", "keyword")).union(node(references, "reference", "cited_work_id"))
    edges = edge(authorships, "author", "author_id", "work", "work_id", "authored").union(edge(works, "work", "work_id", "source", "source_id", "published_in"))
    edges = edges.union(edge(memberships, "work", "work_id", "keyword", "keyword", "has_keyword")).union(edge(references, "work", "citing_work_id", "reference", "cited_work_id", "cites"))
    pairs = authorships.select("author_id", "institution_id").filter("author_id IS NOT NULL AND institution_id IS NOT NULL").distinct()
    return nodes.union(node(authorships, "institution", "institution_id")), edges.union(edge(pairs, "author", "author_id", "institution", "institution_id", "affiliated_with"))
