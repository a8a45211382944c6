"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node that it reaches) of every node in
    ``links`` (columns ``a`` and ``b``).

    Each round takes the smallest label among a node's neighbours and then the label of
    that label, so the distance covered doubles and long chains take few rounds. A round
    is landed in the shared folder; only the number of changed nodes comes to the driver.
    """
    both = landed(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = landed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("at"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = landed(step.join(jump, "at", "left").select(
            "node", "was", F.least("at", F.coalesce("far", "at")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("was <> label").isEmpty():
            return labels
