"""Network features of large universes: no task holds a matrix of all pairs.

Assets are dealt into blocks. A task takes one block's rows of the matrix of a date, tile by tile, against all blocks, and returns
sums and a spanning forest; sums are merged by date, forests are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.components import components
from lattica.operators.network import FEATURES
from lattica.operators.panel import calendar
from lattica.sources.tables import materialize

#: Assets of a block. A task holds a chunk's returns of all assets, one block's roots of weights against all, and a few tiles.
BLOCK = 512


def standard(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, unit vectors) of a window's complete columns that vary: their products are the correlations."""
    keep = ~np.isnan(window).any(0)
    keep[keep] = window[:, keep].max(0) != window[:, keep].min(0)
    x = window[:, keep] - window[:, keep].mean(0)
    return np.flatnonzero(keep), x / np.sqrt((x * x).sum(0))


def _rho(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.clip(x.T @ y, -1, 1).astype(np.float32)


class Forest:
    """A spanning forest of edges between n nodes that come in many arrays: it holds n labels and less than n edges."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Of each round's edges between different trees every tree takes its first, which closes no circle, until none is left."""
        while len(a):
            p, q = self.label[a], self.label[b]
            open_ = p != q
            a, b, p, q = a[open_], b[open_], p[open_], q[open_]
            if not len(a):
                return
            first = np.full(len(self.label), len(a))
            at = np.arange(len(a))
            np.minimum.at(first, p, at)
            np.minimum.at(first, q, at)
            up = np.arange(len(self.label))

            def root(x: int, up: np.ndarray = up) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for k in np.unique(first[first < len(a)]).tolist():
                x, y = root(int(p[k])), root(int(q[k]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    self.edges.append((int(a[k]), int(b[k])))
            while not np.array_equal(up, up[up]):
                up = up[up]
            self.label = up[self.label]


def _roots(rho: np.ndarray, same: bool, bound: np.float32, absolute: bool, keep_sign: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hits, weights with 0 elsewhere) of a tile; on the diagonal no asset meets itself."""
    hit = (np.abs(rho) if absolute else rho) >= bound
    if same:
        np.fill_diagonal(hit, False)
    return hit, np.where(hit, rho if keep_sign else np.abs(rho), 0).astype(float)


def block_row(units: list[np.ndarray], i: int, thresholds: list[float], absolute: bool = True, keep_sign: bool = True) -> list[dict]:
    """Sums over block i's rows of the matrix of one date, by threshold. units: each block's unit vectors, as columns.

    m, w1, w2 and top are the number, sum, sum of squares and greatest of the weights of edges (each edge seen from either end over all
    blocks), d1, d2, s1, s2 sums and sums of squares of degrees and strengths, c the sum of the triangles' cube roots over
    k (k - 1), a1 and a2 those of the absolute correlations. edges is a forest, by place in the order of all columns."""
    own = units[i]
    first = np.cumsum([0, *(u.shape[1] for u in units)])
    out = []
    for t in thresholds:
        bound = np.float32(t)
        degree, strength = np.zeros(own.shape[1]), np.zeros(own.shape[1])
        forest, root = Forest(int(first[-1])), []
        total = dict.fromkeys(("w1", "w2", "a1", "a2"), 0.0) | {"top": -np.inf}
        for j, other in enumerate(units):
            rho = _rho(own, other)
            hit, weight = _roots(rho, i == j, bound, absolute, keep_sign)
            size = np.abs(rho).astype(float)
            if i == j:
                np.fill_diagonal(size, 0)
            total["a1"] += float(size.sum())
            total["a2"] += float((size * size).sum())
            degree += hit.sum(1)
            strength += weight.sum(1)
            total["w1"] += float(weight.sum())
            total["w2"] += float((weight * weight).sum())
            if hit.any():
                total["top"] = max(total["top"], float(weight[hit].max()))
                a, b = np.nonzero(hit)
                forest.add(a + first[i], b + first[j])
            root.append(np.cbrt(weight) if hit.any() else None)
        around = np.zeros(own.shape[1])
        for j in range(len(units)):
            for k in range(j, len(units)):
                if root[j] is not None and root[k] is not None:
                    hit, weight = _roots(_rho(units[j], units[k]), j == k, bound, absolute, keep_sign)
                    if hit.any():
                        around += (1 if j == k else 2) * ((root[j] @ np.cbrt(weight)) * root[k]).sum(1)
        pairs = degree * (degree - 1)
        c = float(np.where(pairs > 0, around / np.maximum(pairs, 1), 0).sum())
        total |= {"m": int(degree.sum()), "d1": float(degree.sum()), "d2": float(degree @ degree), "s1": float(strength.sum()), "s2": float(strength @ strength), "c": c}
        out.append(total | {"n": own.shape[1], "threshold": float(t), "edges": forest.edges})
    return out


def greatest(units: list[np.ndarray]) -> float:
    """The greatest eigenvalue of the matrix of all products of unit vectors: that of the sum of their outer products, which is as
    large as the window is long, however many there are; of the matrix itself where the window is longer."""
    n = sum(u.shape[1] for u in units)
    if n < units[0].shape[0]:
        whole = np.concatenate(units, axis=1)
        return float(np.linalg.eigvalsh(whole.T @ whole)[-1])
    return float(np.linalg.eigvalsh(sum(u @ u.T for u in units))[-1])


def features(
    returns: DataFrame, lookback: int, thresholds: list[float], absolute: bool = True, keep_sign: bool = True, min_assets: int | None = None, block: int = BLOCK, chunk: int | None = None
) -> DataFrame:
    """(date, threshold, the sixteen features), as network.all_features gives them, for universes of any size: a group is a chunk of
    dates and a block of assets, whose tiles of `block` squared correlations are made, summed up and dropped. Eigenvalues come
    from unrounded correlations."""
    chunk = chunk or max(64, lookback)
    dates = calendar(returns)
    # One row an asset: the list of keys is numbered by one task, the panel isn't.
    assets = returns.where("ret IS NOT NULL").select("asset").distinct().withColumn("place", F.row_number().over(Window.orderBy("asset")).cast("long") - 1)
    assets = materialize(assets, "tile-assets")
    n_blocks = -(-assets.count() // block)
    rows = returns.where("ret IS NOT NULL").join(F.broadcast(dates), "date").join(assets, "asset")
    spread = F.sequence(F.floor((F.col("ord") - 1) / chunk), F.floor((F.col("ord") + lookback - 1) / chunk))
    rows = rows.select("ord", "asset", "ret", F.explode(spread).alias("chunk"), F.floor(F.col("place") / block).alias("block"))
    height = chunk + lookback

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        """A block's returns of a chunk and the rows before it as one matrix."""
        k, b = int(group["chunk"].iloc[0]), int(group["block"].iloc[0])
        ids, column = np.unique(group["asset"].to_numpy(), return_inverse=True)
        matrix = np.full((height, len(ids)), np.nan)
        matrix[group["ord"].to_numpy() - 1 - k * chunk + lookback, column] = group["ret"].to_numpy()
        return pd.DataFrame({"chunk": [k], "block": [b], "assets": [ids.astype("<i8").tobytes()], "matrix": [matrix.astype("<f8").tobytes()]})

    packed = materialize(rows.groupBy("chunk", "block").applyInPandas(pack, "chunk long, block long, assets binary, matrix binary"), "tile-returns")
    # Each block's rows need all blocks: a chunk's returns go to as many groups as there are blocks.
    needed = packed.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks - 1, 0)))))
    sums = "ord long, row long, threshold double, n long, m long, w1 double, w2 double, top double, d1 double, d2 double, s1 double, s2 double, c double, a1 double, a2 double, eig1 double, edges array<struct<u:bigint,v:bigint>>"
    names = [x.split()[0] for x in sums.split(", ")]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(each(group), columns=names)

    def each(group: pd.DataFrame) -> Iterator[dict]:
        group = group.sort_values("block")
        own, k = int(group["row"].iloc[0]), int(group["chunk"].iloc[0])
        ids = [np.frombuffer(x, "<i8") for x in group["assets"]]
        matrices = [np.frombuffer(x, "<f8").reshape(height, -1) for x in group["matrix"]]
        if own not in (at := group["block"].tolist()):
            return
        i = at.index(own)
        for o in range(max(k * chunk, lookback) + 1, (k + 1) * chunk + 1):
            until = o - 1 - k * chunk + lookback
            found = [standard(m[until - lookback : until]) for m in matrices]
            n = sum(len(kept) for kept, _ in found)
            # Only dates of the calendar are labelled later; those past its end have no name and go.
            if n < max(2, min_assets or 2) or not len(found[i][0]):
                continue
            units, here = [u for _, u in found], np.concatenate([a[kept] for a, (kept, _) in zip(ids, found, strict=True)])
            # The first block with an asset on this date gives the eigenvalue.
            eig = greatest([u for u in units if u.shape[1]]) if not any(u.shape[1] for u in units[:i]) else None
            for part in block_row(units, i, thresholds, absolute, keep_sign):
                part["edges"] = [{"u": int(here[a]), "v": int(here[b])} for a, b in part["edges"]]
                part["top"] = None if part["top"] == -np.inf else part["top"]
                yield {"ord": o, "row": own, "eig1": eig} | part

    part = materialize(needed.groupBy("chunk", "row").applyInPandas(solve, sums), "tile-sums")
    sum_of = ("n", "m", "w1", "w2", "d1", "d2", "s1", "s2", "c", "a1", "a2")
    total = part.groupBy("ord", "threshold").agg(*(F.sum(x).alias(x) for x in sum_of), F.max(F.nanvl("top", F.lit(None).cast("double"))).alias("top"), F.max(F.nanvl("eig1", F.lit(None).cast("double"))).alias("eig1"))
    edges = part.select("ord", "threshold", F.explode("edges").alias("e")).select("ord", "threshold", "e.u", "e.v")
    size = components(edges, ["ord", "threshold"]).groupBy("ord", "threshold", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = size.groupBy("ord", "threshold").agg(F.max("size").alias("size"))
    n, m, pairs = F.col("n"), F.col("m"), F.col("n") * (F.col("n") - 1)

    def spread_of(one: str, two: str, of) -> F.Column:
        """Population deviation from sums of values and squares."""
        return F.sqrt(F.greatest(F.try_divide(F.col(two), of) - F.try_divide(F.col(one), of) ** 2, F.lit(0.0)))

    zero = lambda x: F.coalesce(x, F.lit(0.0))
    found = total.join(largest, ["ord", "threshold"], "left").join(F.broadcast(dates), "ord")
    found = found.select(
        "date", "threshold", n.alias("n_nodes"), (m / 2).cast("long").alias("n_edges"), (m / pairs).alias("density"), (F.col("d1") / n).alias("avg_degree"), spread_of("d1", "d2", n).alias("std_degree"),
        (F.col("s1") / n).alias("avg_weighted_degree"), spread_of("s1", "s2", n).alias("std_weighted_degree"), zero(F.try_divide("w1", m)).alias("avg_edge_weight"), zero(spread_of("w1", "w2", m)).alias("std_edge_weight"),
        zero(F.col("top")).alias("max_edge_weight"), zero(F.try_divide(F.col("c"), F.col("top") * n)).alias("clustering"), (F.col("size") / n).alias("lcc_ratio"), (F.col("a1") / pairs).alias("avg_abs_corr"),
        spread_of("a1", "a2", pairs).alias("std_abs_corr"), "eig1", (F.col("eig1") / n).alias("eig1_ratio"),
    )
    return found.select("date", "threshold", *FEATURES)
