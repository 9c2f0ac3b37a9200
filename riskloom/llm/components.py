"""Connected components of a table of links, by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import Scratch


def components(links: DataFrame, rounds: int | None = None, keep: Scratch | None = None) -> DataFrame:
    """u, v (long ids) -> node, root: the smallest id of each linked node's component, for every node with a link.

    A round joins every link to the smallest neighbour of one end: sums by key and joins that skew handling can split, so
    a node with most of all links is no hot task. Each round is written to the shared folder; rounds end when nothing
    changes, which takes about the square of the logarithm of the largest component at worst. If `rounds` is given and they
    run out before that, an error says so: unfinished roots are never returned. A round's table goes when the next one is
    written; the last stays in `keep`, or in a folder of its own.
    """
    scratch = keep or Scratch(links.sparkSession, "components")
    now = scratch.cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before, done, last = None, 0, None
    while True:
        if rounds is not None and done == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        done += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(small, F.col("u") == F.col("k"))
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, scratch.cut(moved.unionByName(small.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        scratch.drop(last)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
