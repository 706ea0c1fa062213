"""Connected components over an edge table, by contraction with pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Each round points every node at its smallest neighbour (a partial aggregate, so that a hub is no hot key),
    follows pointers twice, and maps the edges to the roots found; mapped edges keep the graph connected and the
    smallest node of a component never moves. A path shrinks four-fold a round. Rows with a null end are no edges.
    """
    e = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        for _ in range(2):
            up = stored(up, "up")
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(above, "up").select("node", F.col("top").alias("up"))
        up = stored(up, "up")
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            moved = up.select(F.col("node").alias("root"), "up")
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("ra")), up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        mapped = e.join(a, "a").join(b, "b").where("ra <> rb")
        e = stored(mapped.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if labels is None else labels


def rest_against_blocks(rows: DataFrame, cap: int) -> DataFrame:
    """What blocks of one key must still be compared, given the components that links inside blocks made.

    Rows are (key, block, node, root). Nodes outside their key's largest component are its rest: they are cut in blocks
    of about ``cap`` nodes of their own, and meet every block of the key. Returns (key, rest_block, block, node, root,
    rest boolean): one group for each pair of blocks, in which nodes of the rest are to be compared with the others.
    Keys in one component give nothing.
    """
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), (F.sum("n") - F.max("n")).alias("left")).where("left > 0")
    keys = keys.join(rows.groupBy("key").agg((F.max("block") + 1).alias("blocks")), "key").withColumn("rest_blocks", F.ceil(F.col("left") / cap))
    known = stored(rows.select("key", F.col("block").cast("long").alias("block"), "node", "root").join(keys, "key"), "blocks")
    rest = known.where("root <> largest").withColumn("rest_block", F.pmod(F.xxhash64("node"), F.col("rest_blocks")).cast("long"))
    rest = rest.drop("block").select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("blocks") - 1).cast("long"))).alias("block"))
    other = known.select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("rest_blocks") - 1).cast("long"))).alias("rest_block"))
    cols = ["key", "rest_block", "block", "node", "root"]
    return rest.select(*cols, F.lit(True).alias("rest")).unionByName(other.select(*cols, F.lit(False).alias("rest")))
