"""Connected components of a graph of links, by distributed union-find with contraction.

Each round hooks a node to the smallest of its neighbours if that is smaller, jumps every label to its
label's label until all are roots, and replaces the ends of the links by their roots; links within one
tree drop out. What is left is the graph of the next round: a star is done in two rounds, and the roots
left halve within two rounds at least, as one that stays is the least of all nodes two links around it.

Labels and links live in tables in the shared folder, which are deleted once they are replaced; nothing
but whether there are links left, or labels have changed, reaches the driver. Minima are pre-aggregated,
and joins on a label or a centre that many nodes share are plain shuffle joins, whose skewed partitions
Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import discard, keep


def _to_roots(labels: DataFrame, path: str) -> tuple[DataFrame, str]:
    """(node, label) with each label replaced by the root of its tree."""
    spark = labels.sparkSession
    while True:
        up = labels.select(F.col("node").alias("root"), F.col("label").alias("above"))
        jumped, new_path = keep(labels.join(up, labels.label == up.root).select("node", F.col("label").alias("old"), F.col("above").alias("label")), "labels")
        changed = jumped.filter("old != label").limit(1).count()
        discard(spark, path)
        labels, path = jumped.select("node", "label"), new_path
        if not changed:
            return labels, path


def components(links: DataFrame) -> DataFrame:
    """node, component for the ends of ``links`` (a, b); the component is its smallest node.

    Loops and repeated links do no harm; links with a null end are ignored.
    """
    spark = links.sparkSession
    clean = links.select("a", "b").filter("a is not null and b is not null")
    edges, edges_path = keep(clean.union(clean.select("b", "a")).distinct(), "links")
    found, found_path = None, ""
    while True:
        hooked = keep(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
        roots, roots_path = _to_roots(*hooked)
        of = roots.select(F.col("node").alias("of"), F.col("label").alias("top"))
        ends = edges.join(of, edges.a == of.of).select(F.col("top").alias("a"), "b")
        left, left_path = keep(ends.join(of, ends.b == of.of).select("a", F.col("top").alias("b")).filter("a != b").distinct(), "links")
        if found is None:
            found, found_path = roots, roots_path
        else:
            now, now_path = keep(found.join(of, found.label == of.of, "left").select("node", F.coalesce("top", "label").alias("label")), "components")
            discard(spark, found_path, roots_path)
            found, found_path = now, now_path
        discard(spark, edges_path)
        edges, edges_path = left, left_path
        if not edges.limit(1).count():
            discard(spark, edges_path)
            return found.withColumnRenamed("label", "component")
