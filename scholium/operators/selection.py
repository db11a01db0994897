"""What is shown of a network: coupling with a group cap, display selection, merged communities, anchored records.

Selections are small by their parameters (a node limit, a record budget), so what follows them
is broadcast or runs in one task per graph.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholium.operators import networks as N
from scholium.operators.graph import Graph, per_graph


def coupling(references: DataFrame, pool: int, cap: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of bibliographic coupling: citing works linked by what they both cite, ``cap`` works for each reference."""
    return N.pair_network(references, "cited_work_id", "citing_work_id", pool, cap)


def display_selection(nodes: DataFrame, edges: DataFrame, most_nodes: int) -> DataFrame:
    """Edges to draw: the strongest ones within a budget and a maximum spanning forest, so that no part falls off.

    ``nodes`` (node, occurrences, weighted_degree): the ``most_nodes`` by weighted degree + sqrt(occurrences) / 4 stay, ties
    by node. ``edges`` (source, target, weight, association_strength) between them rank by strength x ln(1 + weight), ties by
    ends; the budget is max(2 n, min(3 n, 280)) for n nodes. Nulls count as 0; without nodes or edges the result is empty.
    """
    score = F.coalesce("weighted_degree", F.lit(0)) + F.sqrt(F.greatest(F.coalesce("occurrences", F.lit(0)), F.lit(0))) / 4
    shown = nodes.select("node", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "node").limit(most_nodes).select("node")
    near = F.broadcast(shown)
    inner = edges.join(near.select(F.col("node").alias("source")), "source", "left_semi").join(near.select(F.col("node").alias("target")), "target", "left_semi")
    rank = F.round(F.coalesce("association_strength", F.lit(0.0)) * F.log1p(F.coalesce("weight", F.lit(0)).cast("double")), 12)
    inner = inner.select("source", "target", "weight", "association_strength", rank.alias("score"))
    n = shown.agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "source", "target"))  # at most most_nodes^2 / 2 rows
    top = inner.withColumn("place", place).crossJoin(F.broadcast(n)).withColumn("strong", F.col("place") <= F.greatest(2 * F.col("n"), F.least(3 * F.col("n"), F.lit(280)))).drop("place", "n")
    kind = edges.schema["source"].dataType.simpleString()
    forest = per_graph(inner.select(F.lit("").alias("graph"), "source", "target", F.col("score").alias("weight")), "graph", Graph.spanning_forest, f"graph string, source {kind}, target {kind}, weight double")
    ends = forest.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.lit(True).alias("backbone"))
    rows = top.join(ends, (F.least("source", "target") == F.col("a")) & (F.greatest("source", "target") == F.col("b")), "left")
    return rows.select("source", "target", "weight", "association_strength", "strong", F.coalesce("backbone", F.lit(False)).alias("backbone")).filter("strong OR backbone")


def merge_small(graph: Graph, label: dict, least: int) -> dict:
    """Communities of fewer than ``least`` nodes join the one they are linked to most, in the order of their labels.

    Ties go to the smaller community, then to the earlier one. One without links to any stays by itself, and later ones may
    join it; if all are small, all stay. The result is numbered from 1 by weighted degree, then by smallest node.
    """
    members = defaultdict(list)
    for node in sorted(label):
        members[label[node]].append(node)
    order = [members[k] for k in sorted(members)]
    kept = [m for m in order if len(m) >= least] or order
    home = {v: k for k, m in enumerate(kept) for v in m}
    held = [len(m) for m in kept]
    for small in order:
        if small[0] in home:
            continue
        links = defaultdict(float)
        for v in small:
            for u, w in graph.near.get(v, {}).items():
                if u in home:
                    links[home[u]] += w
        goal = max((k for k, w in links.items() if w > 0), key=lambda k: (links[k], -held[k], -k), default=len(held))
        if goal == len(held):
            held.append(0)
        held[goal] += len(small)
        home.update(dict.fromkeys(small, goal))
    mass, first = defaultdict(float), {}
    for v, k in home.items():
        mass[k] += sum(graph.near.get(v, {}).values())
        first[k] = min(first.get(k, v), v)
    number = {k: i for i, k in enumerate(sorted(mass, key=lambda k: (-mass[k], first[k])), 1)}
    return {v: number[k] for v, k in home.items()}


def merged_communities(edges: DataFrame, key: str, least: int, kind: str = "string") -> DataFrame:
    """(graph, node, community) after :func:`merge_small`, for each graph's own communities."""
    return per_graph(edges, key, lambda g: list(merge_small(g, g.louvain(), least).items()), f"{key} {kind}, node long, community long")


def anchored(graph: Graph, names: dict, importance: dict, question: str, budget: int, salient: int = 8) -> tuple[list, list, list]:
    """(anchors, nodes, edges) that a question asks for, at most ``budget`` records unless its own path needs more.

    Anchors are nodes whose label stands in single quotes in the question, by place. Two or more bring the shortest path (by
    hops) between the first and the last; none brings the ``salient`` most important nodes. Edges at what is held then come
    by weight, with their missing ends, while the budget lasts; then further nodes by importance.
    """
    asked = question.casefold()
    places = sorted((asked.find(f"'{name}'".casefold()), node) for node, name in names.items() if f"'{name}'".casefold() in asked)
    anchors = [node for _, node in places]
    by_rank = sorted(names, key=lambda v: (-importance[v], names[v], v))
    held, taken = dict.fromkeys(sorted(anchors)), {}
    if len(anchors) > 1:
        path = graph.shortest_path(anchors[0], anchors[-1], weighted=False) or []
        held.update(dict.fromkeys(path))
        taken.update((tuple(sorted(e)), None) for e in zip(path, path[1:], strict=False))
    if not held:
        held.update(dict.fromkeys(by_rank[:salient]))
    start = set(held)
    near = sorted({(-w, min(v, u), max(v, u)) for v in start for u, w in graph.near.get(v, {}).items()})
    for _, a, b in near:
        new = [v for v in (a, b) if v not in held]
        if (a, b) not in taken and len(held) + len(taken) + 1 + len(new) <= budget:
            taken[a, b] = None
            held.update(dict.fromkeys(new))
    for v in sorted(names, key=lambda v: (-importance[v], v)):
        if len(held) + len(taken) >= budget:
            break
        held.setdefault(v)
    return anchors, list(held), list(taken)


def anchored_records(edges: DataFrame, nodes: DataFrame, question: str, budget: int, kind: str = "string") -> DataFrame:
    """(graph, position, record, source, target) of :func:`anchored`; the edges first if the question names a node, else the nodes.

    ``nodes``: graph, node, label, importance; ``edges``: graph, source, target, weight. Null labels name nothing.
    """

    def run(key: tuple, e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        graph = Graph(zip(e["source"].tolist(), e["target"].tolist(), e["weight"].tolist(), strict=True))
        names = {v: x or "" for v, x in zip(n["node"].tolist(), n["label"].tolist(), strict=True)}
        anchors, held, taken = anchored(graph, names, dict(zip(n["node"].tolist(), n["importance"].tolist(), strict=True)), question, budget)
        parts = [[("node", v, None) for v in held], [("edge", a, b) for a, b in taken]]
        rows = [r for part in (parts[::-1] if anchors else parts) for r in part]
        return pd.DataFrame({"graph": key[0], "position": range(len(rows)), "record": [r[0] for r in rows], "source": [r[1] for r in rows], "target": pd.array([r[2] for r in rows], "Int64") if kind != "string" else [r[2] for r in rows]})

    return edges.groupBy("graph").cogroup(nodes.groupBy("graph")).applyInPandas(run, f"graph string, position long, record string, source {kind}, target {kind}")
