"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm import common


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each node of ``links`` (a, b) can reach: node, component.

    Each round gives a node the smallest label among its own and its neighbours',
    then that label's own label (pointer jumping), until no label changes.  The
    tables stay distributed; only the number of changed labels reaches the driver."""
    both = common.staged(links.select(F.col("a").alias("node"), F.col("b").alias("next"))
                         .union(links.select("b", "a")).where("node <> next").distinct(), "links")
    labels = common.staged(both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "next"), "next").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        new = lower.join(jump, "low", "left").select(
            "node", F.least("low", F.coalesce("jump", "low")).alias("component"), "was")
        new = common.staged(new, "labels")
        changed = new.where("component <> was").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
