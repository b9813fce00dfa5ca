"""Connected components of many graphs at once, each under its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.sources.tables import materialize

#: Pointer jumps of a round: a chain of 2 ** JUMPS hooks is one hook after them.
JUMPS = 2


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component) for the nodes of edges (keys, u, v): component is a node that all nodes of the component share, and
    those of no other under the same keys. Loops and repeated edges count once; nodes without an edge have no row.

    Each round hooks every node to the least of itself and its neighbours, jumps pointers, and contracts the edges to those between
    different pointers, until none is left. A node that isn't least among its neighbours is hooked, so the nodes with an edge
    halve at least, and rounds grow with the logarithm of the largest graph. Minima are combined before the shuffle, so a hub is
    no hot key. Each round is written."""
    edges = edges.select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct()
    edges = materialize(edges, "component-edges")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy(*keys, "u").agg(F.min("v").alias("p")).select(*keys, "u", F.least("u", "p").alias("p"))
        for _ in range(JUMPS):
            hook = materialize(hook.join(hook.select(*keys, F.col("u").alias("p"), F.col("p").alias("q")), [*keys, "p"]).select(*keys, "u", F.col("q").alias("p")), "component-hooks")
        to = lambda end: hook.select(*keys, F.col("u").alias(end), F.col("p").alias(f"{end}_"))  # noqa: B023,E731
        if found is None:
            found = hook.select(*keys, F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            found = found.join(to("component"), [*keys, "component"], "left").select(*keys, "node", F.coalesce("component_", "component").alias("component"))
        edges = edges.join(to("u"), [*keys, "u"]).join(to("v"), [*keys, "v"]).where("u_ != v_")
        edges = materialize(edges.select(*keys, F.least("u_", "v_").alias("u"), F.greatest("u_", "v_").alias("v")).distinct(), "component-edges")
    return edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")) if found is None else found
