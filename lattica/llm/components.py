"""Connected components by alternating stars over written edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch's edges a spanning forest, of stars around the least nodes."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (a := root(a)) != (b := root(b)):
                parent[max(a, b)] = min(a, b)
        pairs = [(x, y) for x in list(parent) if (y := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["u", "v"])


def components(links: DataFrame, name: str) -> DataFrame:
    """node -> component (its least node) for the nodes of links (a, b); nodes without a link have no row.

    Large and small stars in turn, each a minimum by node (combined before the shuffle) joined back to the edges, until
    nothing changes: a number of rounds that grows with the logarithm of the longest chain. Each round is written."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).mapInArrow(_forest, "u long, v long").distinct()
    edges, before = materialize(edges, name), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(joined.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(edges, name)
