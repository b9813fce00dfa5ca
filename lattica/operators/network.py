"""Threshold networks and their features, from rolling correlations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.components import components
from lattica.operators.correlation import chunked, complete, rolling_pairs, summary
from lattica.operators.panel import calendar
from lattica.sources.tables import materialize

#: The features, in order.
FEATURES = (
    "n_nodes", "n_edges", "density", "avg_degree", "std_degree", "avg_weighted_degree", "std_weighted_degree", "avg_edge_weight",
    "std_edge_weight", "max_edge_weight", "clustering", "lcc_ratio", "avg_abs_corr", "std_abs_corr", "eig1", "eig1_ratio",
)


def edges(pairs: DataFrame, threshold: float, absolute: bool = True, keep_sign: bool = True) -> DataFrame:
    """(date, a1, a2, weight): pairs at the threshold or above, by size or signed, compared as floats."""
    rho, bound = F.col("rho"), F.lit(threshold).cast("float")
    kept = pairs.where((F.abs(rho) if absolute else rho) >= bound)
    return kept.select("date", "a1", "a2", (rho if keep_sign else F.abs(rho)).alias("weight"))


def nodes(returns: DataFrame, lookback: int, min_assets: int | None = None) -> DataFrame:
    """(date, asset): all assets of each date's matrix, isolated ones too."""
    return complete(returns, calendar(returns), lookback, min_assets).select("date", "asset")


def incident(edge: DataFrame) -> DataFrame:
    """(date, asset, other, weight): each edge from both ends."""
    w = F.col("weight").cast("double").alias("weight")
    one = edge.select("date", F.col("a1").alias("asset"), F.col("a2").alias("other"), w)
    return one.unionByName(edge.select("date", F.col("a2").alias("asset"), F.col("a1").alias("other"), w))


def degrees(node: DataFrame, edge: DataFrame) -> DataFrame:
    """By date: n_nodes, n_edges, density, and mean and population deviation of degree and (signed) weighted degree."""
    per = incident(edge).groupBy("date", "asset").agg(F.count(F.lit(1)).alias("d"), F.sum("weight").alias("w"))
    all_ = node.join(per, ["date", "asset"], "left").withColumns({"d": F.coalesce("d", F.lit(0)), "w": F.coalesce("w", F.lit(0.0))})
    by_date = all_.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        (F.sum("d") / 2).cast("bigint").alias("n_edges"),
        F.avg("d").alias("avg_degree"),
        F.stddev_pop("d").alias("std_degree"),
        F.avg("w").alias("avg_weighted_degree"),
        F.stddev_pop("w").alias("std_weighted_degree"),
    )
    return by_date.withColumn("density", F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)))


def edge_weights(node: DataFrame, edge: DataFrame) -> DataFrame:
    """By date: mean, population deviation and (signed) maximum of the weights; 0 without edges."""
    w = F.col("weight").cast("double")
    per = edge.groupBy("date").agg(F.avg(w).alias("avg_edge_weight"), F.stddev_pop(w).alias("std_edge_weight"), F.max(w).alias("max_edge_weight"))
    names = ("avg_edge_weight", "std_edge_weight", "max_edge_weight")
    return node.select("date").distinct().join(per, "date", "left").select("date", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))


def oriented(edge: DataFrame) -> DataFrame:
    """(date, u, v, weight): each edge once, from the end of fewer edges to the other, by id between equals. No node has more than
    the square root of twice the edges leaving it, so the pairs of edges that leave a node are m ** 1.5 at most, whatever hubs
    the graph has."""
    k = incident(edge).groupBy("date", "asset").agg(F.count(F.lit(1)).alias("k"))
    end = lambda x: k.select("date", F.col("asset").alias(x), F.col("k").alias(f"k_{x}"))
    both = edge.join(end("a1"), ["date", "a1"]).join(end("a2"), ["date", "a2"])
    first = F.struct("k_a1", "a1") < F.struct("k_a2", "a2")
    return both.select("date", F.when(first, F.col("a1")).otherwise(F.col("a2")).alias("u"), F.when(first, F.col("a2")).otherwise(F.col("a1")).alias("v"), "weight")


def clustering(node: DataFrame, edge: DataFrame) -> DataFrame:
    """By date: mean over all nodes of the weighted clustering: twice the sum over a node's triangles of the cube roots of
    the products of weights, over k (k - 1), weights relative to the date's greatest; 0 for fewer than two neighbours. Each
    triangle is found once, from its node of fewest edges."""
    top = edge.groupBy("date").agg(F.max("weight").cast("double").alias("top"))
    scaled = edge.join(top, "date").select("date", "a1", "a2", F.try_divide(F.col("weight").cast("double"), F.col("top")).alias("weight"))
    out = oriented(scaled)
    wedges = out.select("date", "u", F.col("v").alias("a1"), F.col("weight").alias("w1")).join(out.select("date", "u", F.col("v").alias("a2"), F.col("weight").alias("w2")), ["date", "u"]).where("a1 < a2")
    triangles = wedges.join(scaled.select("date", F.least("a1", "a2").alias("a1"), F.greatest("a1", "a2").alias("a2"), F.col("weight").alias("w3")), ["date", "a1", "a2"])
    triangles = triangles.select("date", F.explode(F.array("u", "a1", "a2")).alias("asset"), F.cbrt(F.col("w1") * F.col("w2") * F.col("w3")).alias("part"))
    per = triangles.groupBy("date", "asset").agg(F.sum("part").alias("sum"))
    k = incident(edge).groupBy("date", "asset").agg(F.count(F.lit(1)).alias("k"))
    c = F.coalesce(F.try_divide(2 * F.col("sum"), F.col("k") * (F.col("k") - 1)), F.lit(0.0))
    return node.join(k, ["date", "asset"], "left").join(per, ["date", "asset"], "left").groupBy("date").agg(F.avg(c).alias("clustering"))


def largest(n: int, one: np.ndarray, two: np.ndarray) -> int:
    """Nodes of the largest component of one matrix's graph of n nodes."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(one.tolist(), two.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return int(np.bincount([root(x) for x in range(n)]).max(initial=0))


def lcc(node: DataFrame, edge: DataFrame) -> DataFrame:
    """By date: share of nodes in the largest component; null without edges."""
    size = components(edge.select("date", F.col("a1").alias("u"), F.col("a2").alias("v")), ["date"]).groupBy("date", "component").agg(F.count(F.lit(1)).alias("n"))
    found = size.groupBy("date").agg(F.max("n").alias("lcc"))
    n = node.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return n.join(found, "date", "left").select("date", (F.col("lcc") / F.col("n")).alias("lcc_ratio"))


def features(returns: DataFrame, lookback: int, threshold: float, absolute: bool = True, keep_sign: bool = True, min_assets: int | None = None) -> DataFrame:
    """(date, threshold, and the features but the eigenvalues) by the pair path. The pairs are written once and read by each
    feature."""
    pairs = materialize(rolling_pairs(returns, lookback, min_assets), "network-pairs")
    node = materialize(nodes(returns, lookback, min_assets), "network-nodes")
    edge = edges(pairs, threshold, absolute, keep_sign)
    out = degrees(node, edge)
    for part in (edge_weights(node, edge), clustering(node, edge), lcc(node, edge), summary(pairs)):
        out = out.join(part, "date", "left")
    return out.withColumn("threshold", F.lit(float(threshold))).select("date", "threshold", *(c for c in FEATURES if not c.startswith("eig")))


def matrix_features(rho: np.ndarray, threshold: float, absolute: bool, keep_sign: bool) -> tuple:
    """The features of one matrix, in order."""
    n = len(rho)
    a, b = np.triu_indices(n, 1)
    upper = rho[a, b]
    hit = (np.abs(upper) if absolute else upper) >= np.float32(threshold)
    weight = (upper if keep_sign else np.abs(upper))[hit].astype(float)
    m = int(hit.sum())
    dense = np.zeros((n, n))
    dense[a[hit], b[hit]] = dense[b[hit], a[hit]] = weight
    linked = np.zeros((n, n), bool)
    linked[a[hit], b[hit]] = linked[b[hit], a[hit]] = True
    degree, strength = linked.sum(1), dense.sum(1)
    if m:
        root = np.cbrt(dense / weight.max())
        around = np.einsum("ij,jk,ki->i", root, root, root, optimize=True)
        k = degree * (degree - 1)
        cluster = float(np.where(k > 0, around / np.maximum(k, 1), 0).mean())
        lcc_ratio = largest(n, a[hit], b[hit]) / n
        on_edges = (float(weight.mean()), float(weight.std()), float(weight.max()))
    else:
        cluster, lcc_ratio, on_edges = 0.0, None, (0.0, 0.0, 0.0)
    size = np.abs(upper).astype(float)
    values = np.linalg.eigvalsh(rho)
    return (
        n, m, 2 * m / (n * (n - 1)), float(degree.mean()), float(degree.std()), float(strength.mean()), float(strength.std()), *on_edges, cluster, lcc_ratio,
        float(size.mean()), float(size.std()), float(values[-1]), float(values[-1] / values.sum()),
    )


def all_features(returns: DataFrame, lookback: int, thresholds: list[float], absolute: bool = True, keep_sign: bool = True, min_assets: int | None = None, chunk: int | None = None) -> DataFrame:
    """(date, threshold, the sixteen features) by the chunk path, for every threshold: the pairs stay in numpy."""

    def each(date, assets: np.ndarray, rho: np.ndarray) -> list[tuple]:
        return [(date, float(t), *matrix_features(rho, t, absolute, keep_sign)) for t in thresholds]

    kinds = ", ".join(f"{c} {'long' if c[:2] == 'n_' else 'double'}" for c in FEATURES)
    found = chunked(returns, lookback, each, f"date date, threshold double, {kinds}", chunk, min_assets)
    return found.withColumn("lcc_ratio", F.when(~F.isnan("lcc_ratio"), F.col("lcc_ratio")))


def in_window(feature: DataFrame, dates: DataFrame, first: int, last: int) -> DataFrame:
    """Feature rows of the dates numbered first to last; their windows may begin before."""
    return feature.join(F.broadcast(dates.where(F.col("ord").between(first, last)).select("date")), "date", "left_semi")


def on_dates(feature: DataFrame, wanted: DataFrame) -> DataFrame:
    """Feature rows of the wanted dates; those that have none are skipped."""
    return feature.join(wanted, "date", "left_semi")


def middle_date(pairs: DataFrame) -> DataFrame:
    """The date at the middle of those with pairs: one row."""
    dates = calendar(pairs)
    return dates.join(F.broadcast(dates.agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("ord"))), "ord").select("date")
