"""Everything linked over any number of steps, by labels that spread until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.operators.skew import attach
from fixturelake.session import durable


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, least): each node of an edge with the least node it is linked to, over any number of steps.

    A round tells every node the least label of its neighbours, then the label of that label, so chains shrink
    by halves; a node with many links is met salted. Nodes without an edge have no row; no edges give none.
    """
    ends = edges.select(F.col(a).alias("node"), F.col(b).alias("near"))
    both = durable(ends.unionByName(ends.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct())
    labels = durable(both.groupBy("node").agg(F.least("node", F.min("near")).alias("least"), F.count(F.lit(1)).alias("_links")))
    while True:
        told = attach(both, labels.withColumnRenamed("node", "near"), ["near"], "_links").groupBy("node").agg(F.min("least").alias("_told"))
        heard = labels.join(told, "node").withColumn("_low", F.least("least", "_told"))
        named = heard.groupBy("_low").agg(F.count(F.lit(1)).alias("_m"))
        sized = labels.select(F.col("node").alias("_low"), F.col("least").alias("_next")).join(named, "_low")
        jumped = attach(heard, sized, ["_low"], "_m")
        nxt = durable(jumped.select("node", F.least("_low", "_next").alias("least"), "_links", (F.least("_low", "_next") < F.col("least")).alias("_moved")))
        labels = nxt.drop("_moved")
        if not nxt.where("_moved").limit(1).count():
            return labels.select("node", "least")
