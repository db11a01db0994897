"""Registered graph programs over bounded graphs: each filters, aggregates and picks by explicit tie keys.

A program is a function of a :class:`~scholium.operators.graph.Graph` (and node importance)
that returns its answer and the nodes and edges that support it; :func:`run_programs`
applies all of them to every graph of an edge table, one grouped task per graph.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.operators.graph import Graph


def induced(nodes: DataFrame, edges: DataFrame, key: str, scale: int | None) -> tuple[DataFrame, DataFrame]:
    """The ``scale`` most important nodes and their edges, isolates dropped, edges numbered by weight order."""
    top = nodes.orderBy(F.desc("occurrences"), key).limit(scale) if scale else nodes
    ids = F.broadcast(top.select(F.col(key).alias("__k"))) if scale else top.select(F.col(key).alias("__k"))
    inner = edges.join(ids, edges["source"] == ids["__k"], "left_semi").join(ids, edges["target"] == ids["__k"], "left_semi")
    ends = inner.select(F.explode(F.array("source", "target")).alias("__e")).distinct()
    numbered = inner.withColumn("evidence", F.format_string("G%05d", F.row_number().over(Window.orderBy(F.desc("weight"), "source", "target"))))
    return top.join(ends, top[key] == ends["__e"], "left_semi"), numbered


def connector(g: Graph, rank: dict, label: dict, top: int = 40) -> dict | None:
    """The longest 2-4 hop shortest path between important nodes of different communities; the most important ends, then smallest ids, win."""
    best = None
    use = sorted(g.nodes, key=lambda v: (-rank.get(v, 0), v))[:top]
    for i, a in enumerate(use):
        for b in use[i + 1 :]:
            if label[a] == label[b]:
                continue
            path = g.shortest_path(*sorted((a, b)))
            if path and 3 <= len(path) <= 5:
                key = (-len(path), -(rank.get(a, 0) + rank.get(b, 0)), path)
                if best is None or key < best:
                    best = key
    return best and {"path": best[2], "hops": len(best[2]) - 1}


def bridge(g: Graph, label: dict) -> dict | None:
    """The edge of largest betweenness across communities; its removal's effect on hops and components."""
    _, edge = g.betweenness()
    across = [(-c, e) for e, c in edge.items() if label[e[0]] != label[e[1]]]
    if not across:
        return None
    c, (a, b) = min(across)
    around = g.shortest_path(a, b, without=(a, b))
    return {"edge": [a, b], "betweenness": round(-c, 6), "hops_without": len(around) - 1 if around else None, "splits": around is None}


def roles(g: Graph, rank: dict, label: dict) -> dict | None:
    """The community's most important member against its member with the largest external share, in the community where they differ first."""
    for c in sorted(set(label.values())):
        members = [v for v in g.nodes if label[v] == c]
        if len(members) < 2:
            continue
        hub = min(members, key=lambda v: (-rank.get(v, 0), v))

        def share(v, c=c):
            total = sum(g.near[v].values())
            return sum(w for u, w in g.near[v].items() if label[u] != c) / total

        broker = min(members, key=lambda v: (-share(v), v))
        if hub != broker and share(broker) > 0:
            return {"community": c, "hub": hub, "broker": broker, "external_share": round(share(broker), 6)}
    return None


def hub_removal(g: Graph) -> dict | None:
    """The node of largest weighted degree, and the graph without it."""
    if len(g.nodes) < 3:
        return None
    weight = {v: sum(n.values()) for v, n in g.near.items()}
    hub = min(g.nodes, key=lambda v: (-weight[v], v))
    parts = g.components(frozenset((hub,)))
    rest = {v: weight[v] - g.near[v].get(hub, 0) for v in g.nodes if v != hub}
    return {"hub": hub, "components_before": len(g.components()), "components_after": len(parts), "largest_fraction": round(len(parts[0]) / (len(g.nodes) - 1), 6), "next_hub": min(rest, key=lambda v: (-rest[v], v))}


def run_programs(edges: DataFrame, nodes: DataFrame, graph: str, kind: str = "string") -> DataFrame:
    """(graph, program, answer as JSON) for every graph; ``edges``: graph, source, target, weight; ``nodes``: graph, node, occurrences."""

    def run(key: tuple, e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        g = Graph(zip(e["source"].tolist(), e["target"].tolist(), e["weight"].tolist(), strict=True))
        rank = dict(zip(n["node"].tolist(), n["occurrences"].tolist(), strict=True))
        label = g.louvain()
        answers = {"connector": connector(g, rank, label), "bridge": bridge(g, label), "roles": roles(g, rank, label), "hub_removal": hub_removal(g)}
        return pd.DataFrame([(key[0], k, json.dumps(a, sort_keys=True)) for k, a in answers.items() if a is not None], columns=[graph, "program", "answer"])

    return edges.groupBy(graph).cogroup(nodes.groupBy(graph)).applyInPandas(run, f"{graph} {kind}, program string, answer string")


def temporal_shift(trend: DataFrame, term: str, span: int = 3) -> DataFrame:
    """Early and recent counts (first and last ``span`` years of the corpus) and growth (recent + 1) / (early + 1) of each term."""
    years = trend.agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    early, late = F.col("year") < F.col("y0") + span, F.col("year") > F.col("y1") - span
    rows = trend.crossJoin(F.broadcast(years)).groupBy(term).agg(F.sum(F.when(early, F.col("works")).otherwise(0)).alias("early"), F.sum(F.when(late, F.col("works")).otherwise(0)).alias("recent"))
    return rows.withColumn("growth", (F.col("recent") + 1) / (F.col("early") + 1))


def emerging_and_established(shift: DataFrame, degrees: DataFrame, term: str) -> DataFrame:
    """The fastest growing term above the median floor, and the established one with the largest degree."""
    rows = shift.join(degrees.select(F.col("node").alias(term), "weighted_degree"), term)
    floor = rows.agg(F.array_sort(F.collect_list("recent")).alias("xs")).select(F.get("xs", F.floor(F.size("xs") / 2).cast("int")).alias("floor"))
    kept = rows.crossJoin(F.broadcast(floor)).filter("recent >= floor")
    new = kept.orderBy(F.desc("growth"), F.desc("recent"), term).limit(1).select(F.lit("emerging").alias("role"), term, "growth", "weighted_degree")
    old = rows.filter("early > 0").orderBy(F.desc("weighted_degree"), term).limit(1).select(F.lit("established").alias("role"), term, "growth", "weighted_degree")
    return new.unionByName(old)


#: One-factor variants of a robustness check: minimum weight, seed, resolution, dropout, window.
VARIANTS = [("weight", w) for w in (2, 3, 4, 5)] + [("seed", s) for s in (7, 13, 29, 71)] + [("resolution", r) for r in (0.75, 0.9, 1.1, 1.25)] + [("dropout", d) for d in (0.05, 0.1, 0.2, 0.5)] + [("window", w) for w in (2, 4)]


def compare_partitions(base: dict, other: dict) -> dict:
    """Adjusted Rand index over shared nodes and the Jaccard similarity of the node sets."""
    from collections import Counter

    both = sorted(set(base) & set(other))

    def pairs(values) -> float:
        return sum(n * (n - 1) / 2 for n in Counter(values).values())

    cells, a, b = pairs((base[v], other[v]) for v in both), pairs(base[v] for v in both), pairs(other[v] for v in both)
    total = len(both) * (len(both) - 1) / 2
    expected, top = (a * b / total if total else 0.0), (a + b) / 2
    union = set(base) | set(other)
    return {"ari": 1.0 if abs(top - expected) < 1e-12 else (cells - expected) / (top - expected), "jaccard": len(both) / len(union) if union else 1.0}


def replay_differences(expected: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Answers that a replay does not repeat, missing and surplus ones included."""
    rows = expected.withColumnRenamed(value, "expected").join(observed.withColumnRenamed(value, "observed"), keys, "full")
    return rows.filter(~F.col("expected").eqNullSafe(F.col("observed")))
