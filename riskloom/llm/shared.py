"""What the operators of this subpackage share: input tables, scratch tables, and packing of texts into blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources import cut, scratch_dir, written  # noqa: F401

#: The white space that ends a word, as a Java character class: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run in a folder of their own below the shared one. A table may go once what follows from it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{scratch_dir(spark)}/riskloom-{name}-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        out = written(df, f"{self.path}/{self.n}-{name}")
        out.scratch = f"{self.path}/{self.n}-{name}"
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes the given tables, or all of the run if none is given."""
        for path in [t.scratch for t in tables] or [self.path]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def named(*names: str) -> list[Column]:
    """Columns by their exact names, dots and backquotes included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def whole_row(df: DataFrame, *, but: tuple[str, ...] = ()) -> Column:
    """All columns of df as one struct, so that helper columns beside it clash with none; `_row.*` gives them back."""
    return F.struct(*named(*[c for c in df.columns if c not in but])).alias("_row")


def n_words(text: Column) -> Column:
    """Maximal runs of anything but SPACE; null has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(SPACE)) + 1).cast("long")


def blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices of consecutive items whose sizes add up to at most `most`; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches in slices of a few rows, so that no more than these are Python objects at a time."""
    for batch in batches:
        for lo in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(lo, rows)
