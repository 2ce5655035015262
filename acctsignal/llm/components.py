"""Connected components by contraction, with every step in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctsignal.session import materialize


def contract(edges: DataFrame) -> DataFrame | None:
    """(node, label) for each end of ``edges`` (columns a and b, longs): the same label in each component.

    Every node hooks onto its smallest neighbour, chains are shortened, and edges are renamed to what their ends
    hook onto, until none is left. At least half of the nodes go in each step. None if there is no edge.
    """
    labels = None
    left = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        hooked = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                             .select("node", F.least("node", "low").alias("to")), "hooks")
        for _ in range(2):
            further = hooked.select(F.col("node").alias("to"), F.col("to").alias("then"))
            hooked = hooked.join(further, "to").select("node", F.col("then").alias("to"))
        hooked = materialize(hooked, "hooks")
        step = hooked.select(F.col("node").alias("label"), F.col("to"))
        labels = hooked.select("node", F.col("to").alias("label")) if labels is None else materialize(
            labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        of_a, of_b = hooked.toDF("a", "to_a"), hooked.toDF("b", "to_b")
        left = materialize(left.join(of_a, "a").join(of_b, "b").where("to_a <> to_b").select(
            F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    return labels
