"""Connected components and distributed numbering, shared by the operators on links and on ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node in links (a, b), which are read both ways.

    Each round takes the least label among a node's neighbours and then its label's label, so chains shrink
    geometrically. Rounds are written to the shared folder; only a count of changes reaches the driver. A node with
    very many links is summed up before the shuffle and its join can be split. A round's files go once the next one is written."""
    ways = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    ways = materialize(ways, "links")
    labels = materialize(ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "labels")
    while True:
        near = ways.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("far"))
        new = met.join(jump, F.col("component") == F.col("at"), "left").select("node", "old", F.least("component", F.coalesce("far", "component")).alias("component"))
        new = materialize(new, "labels")
        release(labels)
        labels = new.select("node", "component")
        if new.where("component < old").limit(1).count() == 0:
            release(ways)
            return labels


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a column `name` that counts its rows from 0 in the given order, without one task seeing them all."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "numbered")
    part, mask = F.shiftright("_at", 33), (1 << 33) - 1
    sizes = sorted(dealt.groupBy(part.alias("p")).count().collect())  # one row for each partition
    start, total = {}, 0
    for p, n in sizes:
        start[p] = total
        total += n
    offset = F.create_map(*[F.lit(x) for pair in start.items() for x in pair]) if start else F.create_map(F.lit(0).cast("long"), F.lit(0))
    return dealt.withColumn(name, F.element_at(offset, part).cast("long") + F.col("_at").bitwiseAND(F.lit(mask))).drop("_at")
