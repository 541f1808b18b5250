"""Connected components of a distributed edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """node, root (the smallest node of its component) of every node on an edge (a long, b long).

    Each round gives a node the smallest label among its own, its neighbours' and its label's label;
    labels only fall, and the rounds end when none did. Labels of hot nodes are minima, combined before
    the shuffle. Each round is a written table.
    """
    both = tables.keep(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = tables.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        offered = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(offered, "node").select("node", "root", F.least("root", "near").alias("best"))
        # a label that fell also lowers the label of the root it came from
        roots = hooked.where("best < root").groupBy(F.col("root").alias("node")).agg(F.min("best").alias("pulled"))
        hooked = tables.keep(hooked.join(roots, "node", "left").select("node", F.col("root").alias("was"), F.least("best", F.coalesce("pulled", "best")).alias("best")))
        jump = hooked.select(F.col("node").alias("best"), F.col("best").alias("further"))
        new = tables.keep(hooked.join(jump, "best", "left").select("node", "was", F.least("best", F.coalesce("further", "best")).alias("root")))
        tables.drop(hooked)
        fell = new.where("root < was").limit(1).count()
        tables.drop(labels)
        labels = new.select("node", "root")
        labels._tessera_path = new._tessera_path
        if not fell:
            return labels
