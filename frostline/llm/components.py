"""Connected components of a link table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.shared import Run


def components(links: DataFrame, run: Run, name: str = "components") -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): the least node that links reach.

    Each round a node takes the least label among itself and its neighbours, then the label of its
    label, so paths halve. Labels are stored after each round; nothing is held in executors or
    collected but the number of labels that changed. A hub's neighbours are combined before the
    shuffle. Null ends and loops link nothing; an empty table has no nodes.
    """
    pairs = links.select("a", "b").filter("a <> b")
    both = run.store(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = run.store(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"), f"{name}-0")
    for k in range(1, 1_000_000):
        near = (
            both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
            .join(labels, F.col("a") == F.col("node")).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        )
        near = run.store(near, f"{name}-{k}n")
        jump = near.select(F.col("node").alias("to"), F.col("comp").alias("further"))
        labels = run.store(
            near.join(jump, F.col("comp") == F.col("to"), "left")
            .select("node", F.coalesce("further", "comp").alias("comp"), "was"), f"{name}-{k}")
        run.drop(f"{name}-{k}n")
        if labels.filter("comp <> was").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
    return labels
