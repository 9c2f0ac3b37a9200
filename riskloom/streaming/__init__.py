"""The batch operators over streams of changes and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators import decision
from riskloom.operators.assessment import assess


def scan_stream(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Assesses a stream of changes into a Parquet table, each change once: the assessment is a projection of the row, so
    it streams as it is."""
    return assess(changes).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_repeats(deliveries: DataFrame, key: str = "bundle_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first delivery of each key within the watermark."""
    return deliveries.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and kind; rows later than the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.withWatermark(ts, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def latest_cards_stream(cards: DataFrame, path: str, checkpoint: str, every: int = 32) -> StreamingQuery:
    """Keeps the latest card of each change (change_id, ts, card) below path, for read_latest_cards.

    A batch writes its own cards only, into a folder of its number: one that runs twice replaces what it wrote. Every so many
    batches all that is there becomes a snapshot. The snapshot before it, and the batches since, stay until the next, so
    that a batch that is repeated, or a reader at work, finds what it needs.
    """

    def merge(df: DataFrame, n: int) -> None:
        decision.latest_cards(df).write.mode("overwrite").parquet(f"{path}/batches/{n:012d}")
        if n % every == every - 1:
            last, rows = _cards(df.sparkSession, path, before=n)
            decision.latest_cards(rows).write.mode("overwrite").parquet(f"{path}/snapshots/{n:012d}")
            gone = [f"{path}/snapshots/{s:012d}" for s in _folders(df.sparkSession, f"{path}/snapshots") if s < last]
            gone += [f"{path}/batches/{b:012d}" for b in _folders(df.sparkSession, f"{path}/batches") if b <= last]
            for old in gone:
                place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(old)
                place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)

    return cards.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the finished folders below path, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(place)] if fs.exists(place) else []
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def _cards(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, DataFrame]:
    """The number of the last snapshot (earlier than `before`, if given; -1 without one), and its cards with those since."""
    last = max((s for s in _folders(spark, f"{path}/snapshots") if before is None or s < before), default=-1)
    parts = [f"{path}/snapshots/{last:012d}"] * (last >= 0) + [f"{path}/batches/{b:012d}" for b in _folders(spark, f"{path}/batches") if b > last and (before is None or b <= before)]
    return last, spark.read.parquet(*parts)


def read_latest_cards(spark: SparkSession, path: str) -> DataFrame:
    """change_id, ts, card: the latest card of each change that latest_cards_stream has seen."""
    return decision.latest_cards(_cards(spark, path)[1])
