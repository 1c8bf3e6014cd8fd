"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm import text

#: Links that one task of a round writes.
PART_LINKS = 500_000


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that can be reached, for every node of the links (a, b).

    Each round gives a node the smallest root among its own and its neighbours', then the root of that root, and stores the
    table. A round's aggregation is partial before the shuffle, so a node with very many links is no hot group. Ends when a
    round changes nothing; paths shorten by half or more in a round.
    """
    with text.scratch():
        return text.keep(_roots(links), "roots")


def _roots(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = text.stored(both, "links")
    # rounds over few links are all task starts: as many tasks write a round's table as its links fill
    parts = both.count() // PART_LINKS + 1
    both = text.stored(both.coalesce(parts), "links")
    roots = text.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")).coalesce(parts), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = text.stored(step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")).coalesce(parts), "roots")
        roots = step.select("node", "root")
        if step.where("old <> root").limit(1).count() == 0:
            return roots
