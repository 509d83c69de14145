"""Connected components by rounds of joins, each round's edges written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.storage import drop, measured


MIN_FILES, FILE_ROWS = 8, 500_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of the component of every node in ``edges``. Written to the shared folder.

    Large-star and small-star steps in turn: each node sends its larger (then smaller) neighbours to the
    least node it knows. Edges never grow in number; depth halves about every round. Hubs are
    pre-aggregated and their rows joined back by splittable joins. When a round changes nothing, every
    edge leads from a node to its root.

    Defined cases: repeated edges count once; an edge from a node to itself names no component; a null at
    either end is no edge; an empty table gives an empty result.
    """
    marks = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    edges, mark = measured(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges", *marks)
    while mark["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Keyed by the larger node from here on: no hub is one.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").repartition("u")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, before = edges, mark
        # As many files as the edges need, which never grow in number.
        edges, mark = measured(small.where("u <> v").distinct().coalesce(MIN_FILES + mark["n"] // FILE_ROWS), "edges", *marks)
        drop(last)
        if mark == before:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    nodes._siltstone_path = edges._siltstone_path  # the table to drop when the components are read no more
    return nodes
