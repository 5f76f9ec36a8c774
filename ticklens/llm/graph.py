"""Connected components of a large, undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import new_folder, remove_folder


def _written(links: DataFrame) -> tuple[DataFrame, str]:
    """``links`` as files, whose true size is known; a checkpoint's estimate has four times the digits after each round."""
    folder = new_folder(links.sparkSession, "links")
    links.write.parquet(folder)
    return links.sparkSession.read.schema(links.schema).parquet(folder), folder


def _round(links: DataFrame) -> DataFrame:
    """One large star and one small star over links (a, b) with a > b.

    Every node first sends its larger neighbours to the least node it knows, then its smaller ones.
    Minima combine before the shuffle and meet the links by an equi-join, so a node with very
    many neighbours is no single group.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root being the least node reachable.

    Rounds needed grow with the logarithm of the longest chain. Only a count and a checksum
    of the links come back to the driver. No links give no rows; loops and repeats do no harm.
    """
    links, folder = _written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()
        if now == mark:
            break
        mark = now
        if not now[0]:
            break
        before, (links, folder) = folder, _written(_round(links))
        remove_folder(links.sparkSession, before)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
