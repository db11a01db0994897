"""Graph algorithms: components and hop counts as iterative joins, the rest in bounded per-graph tasks.

Connected components and breadth-first hops run on edge tables of any size and cut their
lineage with checkpoints. Betweenness, Louvain, spanning forests and shortest paths are
for the bounded graphs that candidate selection leaves (the node limit is a parameter that
is checked), one grouped task per graph.
"""

from __future__ import annotations

import heapq
from collections import deque
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.session import cut

MOST_NODES = 20_000


def connected_components(spark: SparkSession, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, by label propagation with pointer jumping.

    ``edges`` has (source, target); ``nodes`` (node) adds isolated ones.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = cut(spark, both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("node"))
    if nodes is not None:
        labels = labels.unionByName(nodes.select("node").filter("node IS NOT NULL"))
    labels = cut(spark, labels.distinct().select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        low = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("low", "component")).alias("component"))
        jump = low.select(F.col("node").alias("j"), F.col("component").alias("jc"))
        new = cut(spark, low.join(jump, low["component"] == jump["j"], "left").select("node", F.least("component", F.coalesce("jc", "component")).alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").filter("component <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def hops(spark: SparkSession, edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, hops) within ``most`` hops of each start (start), by frontier joins."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    both = cut(spark, both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"))
    frontier = seen
    for h in range(1, most + 1):
        step = frontier.join(both, frontier["node"] == both["a"]).select("start", F.col("b").alias("node")).distinct()
        frontier = cut(spark, step.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(h)))
        seen = seen.unionByName(frontier)
    return seen


class Graph:
    """A small undirected weighted graph with neighbours in sorted order."""

    def __init__(self, edges):
        self.near: dict = {}
        for a, b, w in edges:
            if a != b:
                self.near.setdefault(a, {})[b] = self.near.get(a, {}).get(b, 0) + w
                self.near.setdefault(b, {})[a] = self.near[a][b]
        if len(self.near) > MOST_NODES:
            raise ValueError(f"{len(self.near)} nodes; select candidates first (at most {MOST_NODES})")
        self.nodes = sorted(self.near)

    def components(self, without=frozenset()) -> list[list]:
        seen, out = set(without), []
        for s in self.nodes:
            if s in seen:
                continue
            part, queue = [], deque([s])
            seen.add(s)
            while queue:
                v = queue.popleft()
                part.append(v)
                for u in self.near[v]:
                    if u not in seen:
                        seen.add(u)
                        queue.append(u)
            out.append(sorted(part))
        return sorted(out, key=lambda p: (-len(p), p[0]))

    def betweenness(self, sources: list | None = None) -> tuple[dict, dict]:
        """Brandes' node and edge betweenness over unweighted shortest paths from ``sources`` (all by default)."""
        node, edge = dict.fromkeys(self.nodes, 0.0), {}
        use = self.nodes if sources is None else sources
        for s in use:
            order, before, paths, far = [], {s: []}, {s: 1.0}, {s: 0}
            queue = deque([s])
            while queue:
                v = queue.popleft()
                order.append(v)
                for u in sorted(self.near[v]):
                    if u not in far:
                        far[u], before[u], paths[u] = far[v] + 1, [], 0.0
                        queue.append(u)
                    if far[u] == far[v] + 1:
                        paths[u] += paths[v]
                        before[u].append(v)
            share = dict.fromkeys(order, 0.0)
            for u in reversed(order):
                for v in before[u]:
                    c = paths[v] / paths[u] * (1 + share[u])
                    share[v] += c
                    key = (v, u) if v < u else (u, v)
                    edge[key] = edge.get(key, 0.0) + c
                if u != s:
                    node[u] += share[u]
        scale = len(self.nodes) / max(1, len(use)) / 2
        return {k: v * scale for k, v in node.items()}, {k: v * scale for k, v in edge.items()}

    def shortest_path(self, a, b, weighted: bool = False, without: tuple | None = None) -> list | None:
        """The shortest path, smallest node first among ties; inverse weights as lengths if ``weighted``."""
        heap, best = [(0.0, [a])], {}
        while heap:
            d, path = heapq.heappop(heap)
            v = path[-1]
            if v == b:
                return path
            if v in best and best[v] <= d:
                continue
            best[v] = d
            for u, w in self.near.get(v, {}).items():
                if without and {u, v} == set(without):
                    continue
                if u not in best:
                    heapq.heappush(heap, (d + (1 / w if weighted else 1), [*path, u]))
        return None

    def louvain(self, resolution: float = 1.0) -> dict:
        """Communities by greedy modularity moves in node order until none improves, then on the merged graph.

        Deterministic; communities are numbered by (-size, smallest node).
        """
        graph = {v: dict(n) for v, n in self.near.items()}
        own = {v: 0.0 for v in graph}
        member = {v: [v] for v in graph}
        total = sum(sum(n.values()) for n in graph.values()) or 1.0
        while True:
            label = {v: v for v in graph}
            strength = {v: sum(n.values()) + own[v] for v, n in graph.items()}
            mass, moved_any, moved = dict(strength), False, True
            while moved:
                moved = False
                for v in sorted(graph):
                    links: dict = {}
                    for u, w in graph[v].items():
                        links[label[u]] = links.get(label[u], 0) + w
                    mass[label[v]] -= strength[v]
                    base = links.get(label[v], 0) - resolution * strength[v] * mass[label[v]] / total
                    gain, best = max(((w - resolution * strength[v] * mass[c] / total, c) for c, w in links.items()), key=lambda x: (x[0], -sorted(links).index(x[1])), default=(base, label[v]))
                    if gain > base + 1e-12 and best != label[v]:
                        label[v], moved, moved_any = best, True, True
                    mass[label[v]] += strength[v]
            if not moved_any:
                break
            new, inner, parts = {}, {}, {}
            for v, n in graph.items():
                c = label[v]
                parts.setdefault(c, []).extend(member[v])
                inner[c] = inner.get(c, 0) + own[v]
                row = new.setdefault(c, {})
                for u, w in n.items():
                    if label[u] == c:
                        inner[c] += w
                    else:
                        row[label[u]] = row.get(label[u], 0) + w
            graph, own, member = new, inner, parts
        groups = sorted((sorted(p) for p in member.values()), key=lambda p: (-len(p), p[0]))
        return {v: k for k, p in enumerate(groups) for v in p}

    def modularity(self, label: dict, resolution: float = 1.0) -> float:
        total = sum(sum(n.values()) for n in self.near.values()) or 1.0
        inside, mass = {}, {}
        for v, n in self.near.items():
            mass[label[v]] = mass.get(label[v], 0) + sum(n.values())
            inside[label[v]] = inside.get(label[v], 0) + sum(w for u, w in n.items() if label[u] == label[v])
        return sum(inside[c] / total - resolution * (mass[c] / total) ** 2 for c in mass)

    def spanning_forest(self) -> list[tuple]:
        """Maximum spanning forest; heaviest first, ties by ends."""
        up = {v: v for v in self.nodes}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for w, a, b in sorted(((w, a, b) for a in self.nodes for b, w in self.near[a].items() if a < b), key=lambda e: (-e[0], e[1], e[2])):
            if root(a) != root(b):
                up[root(a)] = root(b)
                out.append((a, b, w))
        return out


def per_graph(edges: DataFrame, key: str, run, schema: str) -> DataFrame:
    """``run(Graph) -> rows`` for the edges (key, source, target, weight) of each graph."""

    def task(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        graph = Graph(zip(rows["source"], rows["target"], rows["weight"], strict=True))
        return pd.DataFrame([(k[0], *r) for r in run(graph)], columns=[c.split()[0] for c in schema.split(",")])

    return edges.groupBy(key).applyInPandas(task, schema)


def betweenness(edges: DataFrame, key: str, kind: str = "string") -> DataFrame:
    return per_graph(edges, key, lambda g: [(v, len(g.near[v]), c) for v, c in g.betweenness()[0].items()], f"{key} {kind}, node long, degree long, betweenness double")


def communities(edges: DataFrame, key: str, kind: str = "string", resolution: float = 1.0) -> DataFrame:
    return per_graph(edges, key, lambda g: list(g.louvain(resolution).items()), f"{key} {kind}, node long, community long")


def spanning_forest(edges: DataFrame, key: str, kind: str = "string") -> DataFrame:
    return per_graph(edges, key, lambda g: g.spanning_forest(), f"{key} {kind}, source long, target long, weight long")


def community_quotas(sizes: list[int], total: int) -> list[int]:
    """Proportional quotas of at least 1 by largest remainder; no quota above its community's size."""
    n = sum(sizes)
    total = min(total, n)
    ideal = [s * total / n for s in sizes]
    quota = [min(s, max(1, int(x))) for s, x in zip(sizes, ideal, strict=True)]
    while sum(quota) != total:
        step = 1 if sum(quota) < total else -1
        order = sorted(range(len(sizes)), key=lambda k: (-(ideal[k] - quota[k]) * step, k))
        k = next((k for k in order if (quota[k] < sizes[k] if step > 0 else quota[k] > 1)), None)
        if k is None:
            break
        quota[k] += step
    return quota


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings (a, b) of the same nodes."""

    def pairs_of(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(name))

    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("n"))
    total = cells.agg(F.sum("n").alias("n"))
    one = pairs_of(cells, "both").crossJoin(pairs_of(rows, "x")).crossJoin(pairs_of(columns, "y")).crossJoin(pairs_of(total, "t"))
    expected = F.col("x") * F.col("y") / F.greatest("t", F.lit(1e-300))
    top = (F.col("x") + F.col("y")) / 2
    return one.select(F.when(F.abs(top - expected) < 1e-12, 1.0).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))


def descendants(spark: SparkSession, edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(root, node, depth) reachable along directed (parent, child) edges, at most ``most`` steps away; ends when nothing is new."""
    seen = cut(spark, roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    frontier = seen
    for depth in count(1) if most is None else range(1, most + 1):
        step = frontier.join(edges, frontier["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        frontier = cut(spark, step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
