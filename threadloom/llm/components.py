"""Connected components of an edge table, as Spark jobs whose edges shrink each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import discard, work_table


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): for each node of edges (u long, v long) the smallest node it is joined with, itself included.

    Each round hooks every node to its smallest neighbour, jumps once, and keeps only edges of different hooks, so
    that edges at least halve per path; sums per node are partial before they shuffle, so one hot node does no harm.
    Nulls and loops give nothing. An empty table gives no rows.
    """
    edges = work_table(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "edges")
    names = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = work_table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "hooks")
        far = near.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        hook = work_table(near.join(far, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "hooks")
        if names is None:
            new = work_table(hook.select(F.col("u").alias("node"), F.col("p").alias("comp")), "names")
        else:
            new = work_table(names.join(hook, names.comp == hook.u, "left").select("node", F.coalesce("p", "comp").alias("comp")), "names")
        one = edges.join(hook, "u").select(F.col("p").alias("a"), F.col("v").alias("u"))
        two = one.join(hook, "u").select("a", F.col("p").alias("b")).filter("a <> b")
        left = work_table(two.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        discard(near, hook, edges, *([] if names is None else [names]))
        edges, names = left, new
        if edges.isEmpty():
            # A node's hook is its component's smallest node only once no edge is left: name comps by their minimum.
            return names
