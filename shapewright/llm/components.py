"""Connected components of a graph whose links lie in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _compressed(parents: DataFrame) -> DataFrame:
    """Each node with the root above it; steps double until nothing changes."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        new = settle(parents.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
        parents = new.select("node", "parent")
        if new.filter("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (columns u and v, long);
    a component is named by its smallest node.

    Each round hooks every node to the smallest of itself and its neighbours,
    follows the hooks to their roots and keeps the links between roots. At most
    half of the nodes that still have links are roots, so the rounds are few. No
    node's neighbours are ever gathered: a minimum is taken map-side first, and
    both sides of each join are read from settled tables, so that a hub's rows
    can be split. An empty input gives no rows.
    """
    links = settle(links.filter("u <> v").select("u", "v").distinct())
    found: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("v"), F.col("u")))
        hooks = settle(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent")).select("node", F.least("node", "parent").alias("parent")))
        roots = _compressed(hooks)
        if found is None:
            found = roots
        else:
            later = roots.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            found = settle(found.join(later, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")))
        at_u = roots.select(F.col("node").alias("u"), F.col("parent").alias("ru"))
        at_v = roots.select(F.col("node").alias("v"), F.col("parent").alias("rv"))
        links = settle(links.join(at_u, "u").join(at_v, "v").filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
    if found is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.select("node", F.col("parent").alias("component"))
