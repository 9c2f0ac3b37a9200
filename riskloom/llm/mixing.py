"""Mixing sources to target weights by Pareto order sampling.

Targets come from water-filling over one small row per source. A document of a source whose target is f times its size
is due f copies: the whole part of f is certain. For the rest, a document's inclusion probability p is proportional to its
size (to the power of two below it) and capped at 1, such that the expected words are those that the certain copies leave
open. Documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)) with u from a hash of the
document's id, and taken in that order until the next one doesn't fit; the words still open are then filled by the later
ones that are no longer than that. Both cuts are found from a histogram of the ranks by source, so that only documents
within one bin are ever sorted: a source with most of all rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import cut, n_words, whole_row

#: Fixed weights, by rank of the source.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Bits of a hash that make u, and of the rank's bins.
U_BITS, BIN_BITS = 32, 14


def random_bits(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """U_BITS bits from the MD5 of the id, or of the text where there is none (and of a seed other than 0), as a long: the
    same on every run."""
    key = F.coalesce(doc_id.cast("string"), text, F.lit("null"))
    return F.conv(F.substring(F.md5(key if not seed else F.concat(key, F.lit(f"/{seed}"))), 1, U_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> also target: shares of the sum of sizes by weight, none above most times its size.

    One row per source, ranked by code point with null last; weights repeat along the ranks. Filling is closed form:
    sorted by source_size / weight, a source is capped if the words left by all before it give it more than its cap.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("source_size") * most / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))
    s = s.withColumn("_left", left).withColumn("_wsum", F.sum("_w").over(rest)).withColumn("_full", F.col("_left") * F.col("_w") > F.col("source_size") * most * F.col("_wsum"))
    # After the first source that isn't capped, all share what was left there.
    s = s.withColumn("_open", F.max_by(F.struct("_left", "_wsum"), F.when(~F.col("_full"), F.struct("_wsum", "_left"))).over(Window.partitionBy()))
    share = (F.col("_open._left") * F.col("_w")).cast("double") / F.col("_open._wsum")
    return s.select("source", "source_size", F.when(F.col("_full"), (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, source, text -> doc_id, source, size, source_size, target, copies, taken for every row.

    size counts the words of the text (a null text has none). Every source takes its certain copies and, in Pareto
    order (ties: u, doc_id with nulls first, size), the documents that bring it near its target. A document with no words
    is never taken more than certain copies say. Rows with a null source are a source of their own; rows alike in source,
    id (text, if none) and size are taken together. Other columns are left behind.
    """
    d = cut(docs.select("doc_id", "source", *_keys(seed)), "mix")
    out = _copies(d, _plan(d, weights, most))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """The rows of docs with all their columns, each as often as `mix` has copies of it. No row is shuffled."""
    t = _plan(cut(docs.select("doc_id", "source", *_keys(seed)), "mix"), weights, most)
    out = _copies(docs.select(whole_row(docs), "doc_id", "source", *_keys(seed)), t).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def _keys(seed: int) -> list[Column]:
    size = n_words(F.col("text"))
    return [size.alias("size"), random_bits(F.col("doc_id"), F.col("text"), seed).alias("_r")]


def _ranked(d: DataFrame, t: DataFrame) -> DataFrame:
    """d with what t says of its source, its place in Pareto order (_key) and the bin of it; both are null for no words."""
    j = d.join(t, F.col("source").eqNullSafe(F.col("_s")))
    u, p = (F.col("_r") + 0.5) / 2**U_BITS, F.col("_c") * _floor_size()
    q = F.when(p >= 1, 0.0).when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    j = j.withColumn("_q", F.when(F.col("size") > 0, q))
    key = F.when(F.col("_q").isNotNull(), F.struct("_q", "_r", "doc_id", "size"))
    return j.withColumns({"_key": key, "_bin": F.floor(F.col("_q") / (1 + F.col("_q")) * 2**BIN_BITS)})


def _floor_size() -> Column:
    """The largest power of two that is no more than the size."""
    return F.when(F.col("size") > 0, F.expr("shiftleft(1L, length(bin(size)) - 1)")).otherwise(0)


def _plan(d: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row for each source: size and target, certain copies, the words still open (_need), c such that p is c times a
    document's floored size, and where the two passes over the Pareto order end."""
    classes = cut(d.groupBy("source", _floor_size().alias("_w")).agg(F.sum("size").alias("_n")), "mix-classes")
    t = targets(classes.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, most)
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = t.withColumn("_sure", F.floor(f).cast("long")).withColumn("_need", F.greatest(F.lit(0.0), F.col("target") - F.col("_sure") * F.col("source_size"))).withColumnRenamed("source", "_s")
    order = Window.partitionBy("_s").orderBy(F.desc("_w"))
    k = classes.where("_w > 0").join(t.select("_s", "_need"), F.col("source").eqNullSafe(F.col("_s")))
    above = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("_n").cast("decimal(19,0)") * F.col("_w")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    k = k.withColumns({"_left": F.col("_need") - above, "_rest": rest})
    # Sizes whose share would be more than one are certain; those below them share what these leave.
    c = k.groupBy(F.col("_s").alias("_cs")).agg(F.max_by(F.col("_left") / F.col("_rest"), F.when(F.col("_left") * F.col("_w") <= F.col("_rest"), F.col("_w"))).alias("_c"))
    t = cut(t.join(c, F.col("_s").eqNullSafe(F.col("_cs")), "left").drop("_cs").withColumn("_c", F.coalesce("_c", F.lit(0.0))), "mix-sources")
    first = _pass(_ranked(d, t), "_need")
    held = F.col("_before") + F.col("_earlier")
    stop = first.groupBy(F.col("_s").alias("_p")).agg(F.first("_cut").alias("_cut"), F.min(F.when(held + F.col("_n") > F.col("_need"), F.struct("_key", (F.col("_need") - held).alias("gap")))).alias("_stop"))
    t = cut(t.join(stop, F.col("_s").eqNullSafe(F.col("_p")), "left").drop("_p"), "mix-sources")
    second = _pass(_ranked(d, t).where(_later()), "_stop.gap")
    held = F.col("_before") + F.col("_earlier")
    stop = second.groupBy(F.col("_s").alias("_p")).agg(F.first("_cut").alias("_cut2"), F.max(F.when(2 * (F.col("_words") - held) >= F.col("_n"), F.col("_key"))).alias("_stop2"))
    return cut(t.join(stop, F.col("_s").eqNullSafe(F.col("_p")), "left").drop("_p"), "mix-sources")


def _pass(ranked: DataFrame, words: str) -> DataFrame:
    """For each source whose rows outweigh the given words: its rows of the bin in which these end, by key, with the words
    of earlier bins (_before), of earlier keys in the bin (_earlier) and of the key (_n)."""
    r = ranked.where(F.col("_key").isNotNull()).withColumn("_words", F.col(words))
    bins = r.groupBy("_s", "_bin").agg(F.sum("size").alias("_n"), F.first("_words").alias("_words"))
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = bins.where("_before < _words and _before + _n >= _words").select(F.col("_s").alias("_e"), F.col("_bin").alias("_cut_bin"), "_before")
    edge = r.join(ends, F.col("_s").eqNullSafe(F.col("_e")) & (F.col("_bin") == F.col("_cut_bin"))).groupBy("_s", "_key").agg(F.sum("size").alias("_n"), F.first("_before").alias("_before"), F.first("_need").alias("_need"), F.first("_words").alias("_words"), F.first("_bin").alias("_cut"))
    return edge.withColumn("_earlier", F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _later() -> Column:
    """Whether a row comes after the first pass and may fill what it left open."""
    return F.coalesce((F.col("_key") > F.col("_stop._key")) & (F.col("size") <= F.col("_stop.gap")), F.lit(False))


def _copies(d: DataFrame, t: DataFrame) -> DataFrame:
    """d with what _plan says of its source, and copies."""
    j = _ranked(d, t)
    fits = F.coalesce((F.col("_bin") < F.col("_cut")) | ((F.col("_bin") == F.col("_cut")) & (F.col("_stop").isNull() | (F.col("_key") < F.col("_stop._key")))), F.lit(False))
    fills = _later() & F.coalesce(F.col("_cut2").isNull() | (F.col("_bin") < F.col("_cut2")) | ((F.col("_bin") == F.col("_cut2")) & (F.col("_key") <= F.col("_stop2"))), F.lit(False))
    return j.withColumn("copies", F.col("_sure") + (fits | fills).cast("long"))
