"""Connected components of an undirected graph of links, as joins of narrow tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, merged, stage


def components(edges: DataFrame, folder: str) -> DataFrame:
    """id, component (its smallest id) for every id in edges (a, b: long).

    Each round every node takes the smallest label next to it, passes it on to its label's node, and
    takes its label's label; a staged table ends each round's lineage. Labels only fall, and when none
    falls any more, all nodes of a component have its smallest id. As roots learn of smaller labels
    from all of their nodes at once, no path of n nodes tried took more than 1.5 log2 n rounds.
    """
    spark = edges.sparkSession
    links = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{folder}/links")
    labels = stage(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), f"{folder}/labels-0")
    for k in count(1):
        near = links.join(merged(labels), links.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        took = labels.join(merged(near), labels.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # the label's own label: labels are ids, and an id that is a label has a row
        own = labels.select(F.col("id").alias("l"), F.col("label").alias("further"))
        jumped = took.join(merged(own), took.label == own.l, "left").select("id", "old", F.least("label", "further").alias("label"))
        # what a label's nodes have found, for the label's own node
        passed = took.where("label < old").groupBy("old").agg(F.min("label").alias("found")).select(F.col("old").alias("root"), "found")
        hooked = jumped.join(merged(passed), jumped.id == passed.root, "left").select("id", "old", F.least("label", "found").alias("label"))
        done = stage(hooked, f"{folder}/labels-{k}")
        if k > 1:
            delete(spark, f"{folder}/labels-{k - 1}")
        falls = done.where("label < old").limit(1).count()
        labels = done.select("id", "label")
        if not falls:
            return labels.withColumnRenamed("label", "component")
