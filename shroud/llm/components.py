"""Connected components of an edge table, by hooking and pointer jumping with joins.

Each round lowers every node's label, and its label's label, to the least label next to it, then
replaces labels by their labels' labels, so chains shorten by halves. Labels are written to the
shared folder each round. Minima are taken by ``groupBy``, which combines a hot node's messages
before the shuffle; nothing is collected but the number of changed labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.scratch import write_table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge; ``root`` is the least node of its component.

    Self-loops and repeated edges are allowed, edges with a null end are left out.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    pairs = write_table(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = write_table(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = pairs.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("least"))
        told = labels.join(near, "node").select("node", "root", F.least("root", "least").alias("least"))
        down = told.select("node", F.col("least").alias("root")).unionByName(told.where("least < root").select(F.col("root").alias("node"), F.col("least").alias("root")))
        lower = down.groupBy("node").agg(F.min("root").alias("root"))
        jump = lower.join(lower.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
        new = write_table(jump.select("node", F.least("root", "up").alias("root")), "labels")
        if new.join(labels.withColumnRenamed("root", "old"), "node").where("root < old").isEmpty():
            return new
        labels = new
