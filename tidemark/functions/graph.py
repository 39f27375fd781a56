"""Groups of linked rows, by rounds of joins whose results are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut


def link_groups(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node it is linked with, itself included.

    A forest of labels: each round gives every root the smallest label that a link offers to any member, then shortens
    the paths to the labels' own labels. Labels only fall, and a group of n nodes needs about log n rounds. Each round is
    a few partial minima and joins, stored; nothing but one flag a round reaches the driver.
    """
    pairs = links.filter("a <> b").select("a", "b")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    while True:
        seen = both.join(labels, both["a"] == labels["node"]).select("b", "root")
        offers = seen.groupBy(F.col("b").alias("node")).agg(F.min("root").alias("offer"))
        told = labels.join(offers, "node", "left").select("node", "root", F.least("root", "offer").alias("best"))
        # the old root learns what any of its members was offered, and hands it on
        hooks = told.groupBy(F.col("root").alias("hook")).agg(F.min("best").alias("to"))
        hooked = told.join(hooks, F.col("root") == F.col("hook"), "left").select("node", F.col("root").alias("old"), F.least("best", "to").alias("root"))
        hooked = cut(hooked, "hooked")
        above = hooked.select(F.col("node").alias("up"), F.col("root").alias("upper"))
        jumped = hooked.join(above, F.col("root") == F.col("up"), "left").select("node", "old", F.least("root", "upper").alias("root"))
        jumped = cut(jumped, "labels")
        labels = jumped.select("node", "root")
        if jumped.filter("old <> root").isEmpty():
            return labels
