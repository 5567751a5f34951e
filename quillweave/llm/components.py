"""Connected components of a link table, by alternating large and small stars.

Each round hangs all larger neighbours of a node, then all smaller ones, on the node's least neighbour. Links never grow
in number, nothing is gathered per node (minima are aggregated before the shuffle, and the minima of the few nodes with
very many links are sent to all tasks), and every round is written to the shared folder, where it replaces the one before.

Cases: links of a node with itself and repeated links add nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillweave.llm.common import drop, joined, saved


def connected_components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of links (columns a and b), itself a root or not."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = saved(links.distinct(), "links")
    while True:
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).union(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n"))
        least = saved(least.select(F.col("x").alias("v"), F.least("x", "m").alias("m"), "n"), "least")
        large = joined(links, least, "v", "n", links.count(), "inner").select("u", F.col("m").alias("v")).distinct()
        links = saved(large, "large-star", links, least)
        least = saved(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        down = joined(links, least, "u", "n", links.count(), "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = saved(least.select("u", F.col("m").alias("v")).union(down).distinct(), "small-star", links, least)
        hanging = links.select(F.col("u").alias("w")).distinct()
        if links.join(hanging, links["v"] == hanging["w"], "left_semi").isEmpty():
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
