"""Connected components by contraction, on tables in the shared folder; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) for every vertex of edges (a, b): label is the smallest vertex that it reaches.

    Every vertex points to its smallest neighbour or itself, pointers are followed to their ends by doubling, and the
    graph is contracted to those ends until no edge is left. Stars take one round; minima are summed before
    shuffles, so a vertex with very many edges is no hot key.
    """
    edges = edges.select("a", "b").where("a <> b")
    total = None
    while True:
        both = edges.union(edges.select("b", "a"))
        to = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "pointers")
        while True:
            ends = to.select(F.col("id").alias("to"), F.col("to").alias("end"))
            jumped = saved(to.join(ends, "to").select("id", "to", "end"), "pointers")
            moved = jumped.where("to <> end").limit(1).count()
            to = jumped.select("id", F.col("end").alias("to"))
            if not moved:
                break
        if total is None:
            total = to.select("id", F.col("to").alias("label"))
        else:
            total = saved(total.join(to.select(F.col("id").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        a, b = to.select(F.col("id").alias("a"), F.col("to").alias("ta")), to.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        edges = saved(edges.join(a, "a").join(b, "b").where("ta <> tb").select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return total
