"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a DataFrame job whose result is written to the shared folder; nothing but the
number of edges and a checksum of them reaches the driver. Edges of a node that has very many
are joined in several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.storage import materialize

#: Keys that hold more than this part of all rows are dealt to several tasks: there are fewer than so many of them.
SHARE = 4096
#: ... if they hold more rows than this.
LEAST = 256


def salted_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], by: Column, total: int) -> DataFrame:
    """``rows`` joined with ``groups`` (one row per key; ``n``: rows of the key, dropped) on ``keys``. The rows of a key
    that holds more than total / SHARE of them are parted by ``by``. Fewer than SHARE keys can, and so their list is broadcast."""
    most = max(LEAST, total // SHARE)
    cut = groups.withColumn("salts_", F.ceil(F.col("n") / F.lit(most)).cast("int")).drop("n")
    hot = cut.where("salts_ > 1").select(*keys, F.col("salts_").alias("hot_"))
    left = rows.join(F.broadcast(hot), list(keys), "left").withColumn("salt_", F.pmod(by, F.coalesce("hot_", F.lit(1))).cast("int")).drop("hot_")
    right = cut.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.col("salts_") - 1))).drop("salts_")
    return left.join(right, [*keys, "salt_"]).drop("salt_")


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Edges (u, v), u > v. Large star ties each larger neighbour of a node to the node's least neighbour, small star the rest."""
    if large:
        edges = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = salted_join(edges, least, ["u"], F.xxhash64("v"), 2 * total)
    if large:
        tied = tied.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where(F.col("u") > F.col("v"))
        # a node's own tie to a smaller least neighbour is made where that neighbour's turn comes
        return tied.distinct()
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """node, component (the least node reachable), for each node that has an edge to another one.

    ``edges`` may hold repeats, loops, either direction and nulls (dropped); an empty table gives none.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = materialize(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"), x.isNotNull().alias("p"), y.isNotNull().alias("q")).where("p and q and u > v").select("u", "v").distinct(), label)
    before = None
    while True:
        after = _sum(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
        if not after[0]:
            continue
        now = materialize(_star(_star(now, True, after[0]), False, after[0]), label)


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum("v")).first()
    return tuple(r)
