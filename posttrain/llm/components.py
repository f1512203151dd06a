"""Connected components of a link table (union-find by joins).

Each round gives every node the smallest label among its neighbours' and its own,
then replaces labels by their own labels (pointer jumping), so the number of
rounds grows with the logarithm of the longest chain. Minima are summed up before
the shuffle; a node with a third of all links costs one row per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttrain.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links``: ``root`` is the smallest node of
    its component. Self links and repeated links change nothing; null ends are
    left out; no links give no rows."""
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = stored(pairs.union(pairs.select("other", "node")).where("node <> other").distinct(), "links")
    labels = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root"))
    labels = stored(labels, "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node")
                .agg(F.min("root").alias("near")))
        hooked = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("to"))
        # the root of a changed tree follows its smallest new label
        moved = hooked.where("root <> to").groupBy("root").agg(F.min("to").alias("over")).select(F.col("root").alias("old"), "over")
        step = hooked.join(moved, hooked["to"] == moved["old"], "left").select("node", "root", F.coalesce("over", "to").alias("to"))
        jump = step.select(F.col("node").alias("at"), F.col("to").alias("up"))
        new = stored(step.join(jump, step["to"] == jump["at"], "left")
                     .select("node", F.least("to", F.coalesce("up", "to")).alias("root"), (F.col("root") != F.least("to", F.coalesce("up", "to"))).alias("changed")),
                     "labels")
        labels = new.select("node", "root")
        if new.where("changed").limit(1).count() == 0:
            return labels
