"""Sector communities: similarity graph from the Leontief inverse, Louvain partition, names."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonaria.session import materialise

MAX_NODES = 5_000  #: sectors up to which the partition is computed on the driver


def similarity(l_matrix: DataFrame, top_k: int = 8, threshold: float = 0.0005) -> DataFrame:
    """(i, j, w), both directions: columns over their sums, made symmetric, the top_k largest per row (the diagonal
    competes but is no edge), entries below the threshold gone.  ``l_matrix`` is (i, j, l) of one state."""
    total = l_matrix.groupBy("j").agg(F.sum("l").alias("_t"))
    n = l_matrix.join(total, "j").select("i", "j", (F.col("l") / F.col("_t")).alias("w"))
    half = n.select("i", "j", F.col("w") / 2).union(n.select(F.col("j"), F.col("i"), F.col("w") / 2)).toDF("i", "j", "w")
    s = half.groupBy("i", "j").agg(F.sum("w").alias("w"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc(F.round("w", 12)), "j"))
    kept = s.withColumn("_r", rank).filter((F.col("_r") <= top_k) & (F.col("w") >= threshold) & (F.col("i") != F.col("j")))
    both = kept.select("i", "j", "w").union(kept.select("j", "i", "w")).toDF("i", "j", "w")
    return both.groupBy("i", "j").agg(F.max("w").alias("w"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, componente): the smallest id reachable, by min-label propagation with pointer jumping."""
    label = edges.select(F.col("i").alias("id")).union(edges.select("j")).distinct().withColumn("componente", F.col("id"))
    label = materialise(label)
    for _ in range(rounds):
        near = edges.join(label.select(F.col("id").alias("j"), "componente"), "j").groupBy(F.col("i").alias("id")).agg(F.min("componente").alias("_m"))
        step = label.join(near, "id", "left").select("id", "componente", F.least("componente", F.coalesce("_m", "componente")).alias("n"))
        jump = label.select(F.col("id").alias("n"), F.col("componente").alias("_j"))
        new = materialise(step.join(jump, "n", "left").select("id", F.least("n", F.coalesce("_j", "n")).alias("nuevo"), "componente"))
        moved = new.filter("nuevo <> componente").limit(1).count()
        label = new.select("id", F.col("nuevo").alias("componente"))
        if not moved:
            break
    return label


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes, ties to the smallest label."""
    lab = components(edges)
    best = lab.groupBy("componente").count().orderBy(F.desc("count"), "componente").limit(1).select("componente")
    inside = lab.join(best, "componente").select(F.col("id").alias("i"))
    return edges.join(inside, "i", "left_semi")


def modularity(adj: dict, part: dict, resolution: float) -> float:
    """Q of a partition of an undirected weighted graph {node: {neighbour: weight}}."""
    two_m = sum(sum(v.values()) for v in adj.values())
    if not two_m:
        return 0.0
    inside, degree = defaultdict(float), defaultdict(float)
    for u, near in adj.items():
        degree[part[u]] += sum(near.values())
        inside[part[u]] += sum(w for v, w in near.items() if part[v] == part[u])
    return sum(inside[c] / two_m - resolution * (degree[c] / two_m) ** 2 for c in degree)


def louvain(adj: dict, resolution: float = 1.0, seed: int = 42) -> dict:
    """{node: community}: greedy moves to the best gain, then the communities as nodes, until nothing gains.

    Nodes are visited in an order drawn from the seed; equal gains go to the
    smallest community.  Communities are numbered by size, then first node.
    """
    rng = np.random.default_rng(seed)
    graph = {u: dict(v) for u, v in adj.items()}
    where = {u: u for u in adj}
    two_m = sum(sum(v.values()) for v in adj.values())
    while two_m:
        part = {u: k for k, u in enumerate(sorted(graph))}
        degree = {u: sum(v.values()) for u, v in graph.items()}
        total = {part[u]: degree[u] for u in graph}
        order = sorted(graph)
        rng.shuffle(order)
        gained, moved = False, True
        while moved:
            moved = False
            for u in order:
                old = part[u]
                total[old] -= degree[u]
                links = defaultdict(float)
                for v, w in graph[u].items():
                    if v != u:
                        links[part[v]] += w
                score = {c: links[c] - resolution * total[c] * degree[u] / two_m for c in {*links, old}}
                best = min(score, key=lambda c: (-round(score[c], 12), c))
                if best != old and score[best] <= score[old] + 1e-12:
                    best = old
                total[best] += degree[u]
                if best != old:
                    part[u], moved, gained = best, True, True
        if not gained:
            break
        where = {u: part[c] for u, c in where.items()}
        merged: dict = defaultdict(lambda: defaultdict(float))
        for u, near in graph.items():
            for v, w in near.items():
                merged[part[u]][part[v]] += w
        graph = {c: dict(v) for c, v in merged.items()}
    groups = defaultdict(list)
    for u, c in where.items():
        groups[c].append(u)
    ranked = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    return {u: k for k, g in enumerate(ranked) for u in g}


def centrality(adj: dict, steps: int = 1000) -> dict:
    """Eigenvector centrality; degrees where it doesn't settle."""
    ids = sorted(adj)
    at = {u: k for k, u in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for u, near in adj.items():
        for v, w in near.items():
            m[at[u], at[v]] = w
    x = np.full(len(ids), 1 / max(1, len(ids)) ** 0.5)
    for _ in range(steps):
        y = m @ x + x
        y /= np.linalg.norm(y) or 1.0
        if abs(y - x).sum() < 1e-6 * len(ids):
            return dict(zip(ids, map(float, y), strict=True))
        x = y
    return {u: float(sum(adj[u].values())) for u in ids}


def communities(spark: SparkSession, edges: DataFrame, links: DataFrame, names: DataFrame, resolution: float = 0.15, seed: int = 42) -> DataFrame:
    """(cluster_id, sector, centralidad, nombre, n_sectores, centralidad_media, bl_media, fl_media).

    ``edges`` (i, j, w) of the largest component, ``links`` (sector, bl, fl),
    ``names`` (sector, nombre).  A community bears the name of its most central
    member, ties to the smallest sector; means have six decimals.  The sector
    graph is bounded by MAX_NODES and partitioned on the driver.
    """
    if edges.select("i").distinct().count() > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} sectors")
    adj: dict = defaultdict(dict)
    for r in edges.collect():
        adj[r["i"]][r["j"]] = r["w"]
    part, central = louvain(adj, resolution, seed), centrality(adj)
    rows = [(part[u], u, central[u]) for u in sorted(adj)]
    d = spark.createDataFrame(rows, "cluster_id int, sector string, centralidad double").join(links, "sector", "left").join(names, "sector", "left")
    first = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.round("centralidad", 9)), "sector"))
    w = Window.partitionBy("cluster_id")
    mean = lambda c: F.round(F.avg(c).over(w), 6)
    d = d.withColumn("_r", first)
    title = F.max(F.when(F.col("_r") == 1, F.coalesce("nombre", "sector"))).over(w)
    return d.select(
        "cluster_id", "sector", "centralidad", title.alias("nombre"), F.count("*").over(w).alias("n_sectores"),
        mean("centralidad").alias("centralidad_media"), mean("bl").alias("bl_media"), mean("fl").alias("fl_media"),
    )
