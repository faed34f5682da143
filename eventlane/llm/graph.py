"""Connected components of links that live on the executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlane.session import staged


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """One contraction: neighbours move to the least node of a star."""
    if small:
        own = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        own = links.union(links.select("b", "a"))
    least = own.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("hub"), F.least("low", "a").alias("low"))
    # The right side has one row a node, so a hub's rows may be split over tasks.
    joined = own.join(least, own["a"] == least["hub"])
    if small:
        moved = joined.select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("x")).select("x.*")
    else:
        moved = joined.where("b > a").select("b", "low")
    return moved.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that occurs in ``links``; ``root`` is the least node reachable.

    Alternates large-star and small-star contractions; each round is written
    to the shared folder, so a lost executor costs a re-read. Rows with a null
    end and links of a node to itself are no links. An empty table gives none.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = staged(pairs.distinct(), "links")
    seen = None
    while True:
        edges = staged(_stars(_stars(edges, small=False), small=True), "stars")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(":", "a", "b")))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b").distinct())
