"""Connected components by contraction: each node takes its smallest neighbour, chains are followed to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wegloom.plans.shared import Scratch


def flatten(parents: DataFrame, name: str) -> tuple[DataFrame, Scratch]:
    """node, parent with every parent replaced by the root that it leads to; a root is its own parent. And its table."""
    own = Scratch(parents.sparkSession)
    parents = own.keep(parents, name)
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = own.keep(parents.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), name)
        own.drop(but=1)
        parents = step.select("node", "parent")
        if not step.where("moved").limit(1).count():
            return parents, own


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of the undirected edges; component is the smallest node reachable.

    Each round at least halves the number of components that still have edges between them, and a component's smallest
    node always stays its root. Loops and repeated edges do no harm; an empty table gives no rows. A round's tables are
    dropped with the next; the result's own stays until the session ends.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a)))
    rest, result = Scratch(spark), Scratch(spark)
    links = rest.keep(both.where("u is not null and v is not null").distinct(), "links")
    found = None
    while found is None or links.limit(1).count():
        least = links.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("parent"))
        roots, own = flatten(least, "roots")
        if found is None:
            found = roots.select("node", F.col("parent").alias("component"))
        else:
            up = roots.select(F.col("node").alias("component"), F.col("parent").alias("root"))
            found = found.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        found = result.keep(found, "components")
        result.drop(but=1)
        left, right = roots.select(F.col("node").alias("u"), F.col("parent").alias("ru")), roots.select(F.col("node").alias("v"), F.col("parent").alias("rv"))
        links = rest.keep(links.join(left, "u").join(right, "v").where("ru != rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "links")
        rest.drop(but=1)
        own.drop()
    rest.drop()
    return found
