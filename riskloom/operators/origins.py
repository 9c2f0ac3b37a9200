"""Where a fixed flaw came from: line ranges, their attribution to commits, and sampling of clean changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.lines import is_config, is_doc, is_test

#: Lines in a bucket of the range join.
BUCKET = 256


def deleted_ranges(lines: DataFrame, keys: tuple[str, ...] = ("change_id", "path"), number: str = "line_number") -> DataFrame:
    """keys, start, end: islands of consecutive numbers."""
    d = lines.select(*keys, F.col(number).alias("n")).distinct()
    g = d.withColumn("_g", F.col("n") - F.row_number().over(Window.partitionBy(*keys).orderBy("n")))
    return g.groupBy(*keys, "_g").agg(F.min("n").alias("start"), F.max("n").alias("end")).drop("_g")


def context_ranges(points: DataFrame, around: int = 5, keys: tuple[str, ...] = ("change_id", "path"), number: str = "line_number") -> DataFrame:
    """keys, start, end: intervals around points; those that overlap or touch are one, and none starts below 1."""
    i = points.select(*keys, F.greatest(F.col(number) - around, F.lit(1)).alias("start"), (F.col(number) + around).alias("end"))
    order = Window.partitionBy(*keys).orderBy("start", "end")
    return _joined(i, keys)


def _joined(ranges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, start, end: ranges that overlap or touch as one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    i = ranges.withColumn("_before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    i = i.withColumn("_g", F.sum((F.col("_before").isNull() | (F.col("start") > F.col("_before") + 1)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def prioritise(ranges: DataFrame, most: int = 20) -> DataFrame:
    """Source files before tests; documentation only where a change has nothing else; at most so many files a change."""
    kind = F.when(is_doc(F.col("path")), 2).when(is_test(F.col("path")), 1).otherwise(0)
    r = ranges.withColumn("_kind", kind).withColumn("_best", F.min(F.least("_kind", F.lit(2))).over(Window.partitionBy("change_id")))
    r = r.where("_kind < 2 or _best = 2").withColumn("file_rank", F.dense_rank().over(Window.partitionBy("change_id").orderBy("_kind", "path")))
    return r.where(F.col("file_rank") <= most).drop("_kind", "_best")


def candidates(ranges: DataFrame, blame: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """ranges (change_id, keys, start, end) and blame (keys, line_no, sha, ...) -> change_id, sha, lines for lines in a range.

    A range is spread over buckets of BUCKET lines, so the join is an equality of keys and bucket with the range as a
    filter: nothing is broadcast, and a long file doesn't meet all ranges of its path. A change's ranges are made disjoint
    and a line's repeats under one commit are dropped before it, so what follows counts rows, and a task sends one row for
    each change and commit it saw instead of every line.
    """
    r = _joined(ranges.where("start <= end").select("change_id", *keys, "start", "end"), ("change_id", *keys))
    r = r.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET))))
    b = blame.groupBy(*keys, "line_no", "sha").agg(F.min("commit_date").alias("commit_date")).withColumn("_b", F.floor(F.col("line_no") / BUCKET))
    j = r.join(b, [*keys, "_b"]).where("line_no between start and end")
    return j.groupBy("change_id", "sha").agg(F.count("*").alias("lines"), F.min("commit_date").alias("commit_date"))


def rank_candidates(found: DataFrame, merges: DataFrame, most: int = 5) -> DataFrame:
    """Without merge commits, the oldest of each change first."""
    w = Window.partitionBy("change_id").orderBy("commit_date", "sha")
    return found.join(merges.select("sha"), "sha", "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def origin_flags(changes: DataFrame, deleted: DataFrame, context: DataFrame, ranked: DataFrame, initial: DataFrame, most_files: int = 20) -> DataFrame:
    """change_id, flags (in order) for every change (change_id, diff) whose origin was looked for.

    empty_diff: no text, or no range of either kind; add_only_fix: no deleted range (change_id, path, ...), so the context's
    count; too_many_files: more paths than most_files; blame_error: no candidate (ranked: change_id, sha, rank);
    initial_commit_candidate: the first candidate is among initial (sha).
    """
    paths = lambda df, name: df.groupBy("change_id").agg(F.countDistinct("path").alias(name))
    first = ranked.where("rank = 1").join(initial.select("sha", F.lit(True).alias("_initial")).distinct(), "sha", "left").select("change_id", F.lit(True).alias("_found"), "_initial")
    j = changes.select("change_id", (F.trim(F.coalesce("diff", F.lit("")), F.lit(" \t\r\n")) == "").alias("_blank")).join(paths(deleted, "_deleted"), "change_id", "left").join(paths(context, "_context"), "change_id", "left").join(first, "change_id", "left")
    added = ~F.col("_blank") & F.col("_deleted").isNull()
    empty = F.col("_blank") | (added & F.col("_context").isNull())
    many = ~empty & (F.coalesce("_deleted", "_context") > most_files)
    flags = [F.when(added, "add_only_fix"), F.when(empty, "empty_diff"), F.when(many, "too_many_files"), F.when(~empty & F.col("_found").isNull(), "blame_error"), F.when(~empty & F.col("_initial"), "initial_commit_candidate")]
    return j.select("change_id", F.array_compact(F.array(*flags)).alias("flags"))


def clean_sample(files: DataFrame, changes: DataFrame, per_repo: int = 2, least: int = 3) -> DataFrame:
    """change_id, repo, rank: changes that touch only documentation, tests or configuration, with `least` lines or more."""
    p = F.col("path")
    f = files.groupBy("change_id").agg(F.bool_and(is_doc(p) | is_test(p) | is_config(p)).alias("ok"), F.sum(F.col("added") + F.col("removed")).alias("n")).where(F.col("ok") & (F.col("n") >= least))
    w = Window.partitionBy("repo").orderBy("change_id")
    return f.join(changes.select("change_id", "repo"), "change_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_repo).select("change_id", "repo", "rank")
