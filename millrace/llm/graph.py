"""Connected components by contraction, all in tables: nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, write_table


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for all nodes of `links` (a, b); the label is the least node of the component.

    Each round every label takes its least neighbour, takes that one's in turn, and the links are
    rewritten to labels; links within a label go. A hub with very many links costs rows that are
    aggregated before they travel, and joins whose large side can be split.
    """
    links = write_table(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = write_table(nodes.select("node", F.col("node").alias("label")), name)
    while not links.isEmpty():
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        step = write_table(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")), name)
        again = step.select(F.col("u").alias("to"), F.col("to").alias("further"))
        jump = write_table(step.join(again, "to", "left").select("u", F.coalesce("further", "to").alias("to")), name)
        forget(step)
        new = write_table(
            links.join(jump.select(F.col("u").alias("a"), F.col("to").alias("x")), "a").join(jump.select(F.col("u").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name,
        )
        relabelled = write_table(labels.join(jump.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), name)
        for old in (links, jump, labels):
            forget(old)
        links, labels = new, relabelled
    forget(links)
    return labels
