"""Every query with SQL gives the SQL's rows on the smallest tables; streams give the batch's rows."""

import math
import os

import duckdb
import pytest

from riskloom.plans.oracle import ORACLE
from riskloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = duck.sql(ORACLE[name])
    assert sorted(r.columns) == cols
    want = sorted([plain(x[r.columns.index(c)]) for c in cols] for x in r.fetchall())
    assert sorted([plain(x[c]) for c in cols] for x in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_streams_give_the_rows_of_the_batch(spark, tmp_path):
    from riskloom import streaming
    from riskloom.plans import inputs

    changes = inputs.changes(spark, DATA)
    changes.repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.scan_stream(src, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = streaming.assess(changes)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def cards(spark, tmp_path, batches, every):
    from riskloom import streaming

    for rows in batches:
        spark.createDataFrame(rows, "change_id long, ts long, card string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema("change_id long, ts long, card string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        streaming.latest_cards_stream(src, str(tmp_path / "out"), str(tmp_path / "cp"), every).awaitTermination()
    return sorted((r.change_id, r.card) for r in streaming.read_latest_cards(spark, str(tmp_path / "out")).collect())


def test_latest_card_stays_across_batches_and_snapshots(spark, tmp_path):
    batches = [[(1, 1, "a"), (2, 5, "b")], [(1, 3, "c"), (2, 4, "d")], [(3, 1, "e")], [(1, 2, "f")], [(3, 2, "g"), (3, 0, "h")], [(2, 6, "i")]]
    assert cards(spark, tmp_path, batches, 2) == [(1, "c"), (2, "i"), (3, "g")]
    kept = {d: sorted(int(p.name) for p in (tmp_path / "out" / d).iterdir()) for d in ("snapshots", "batches")}
    assert kept == {"snapshots": [3, 5], "batches": [4, 5]}


def test_a_small_batch_writes_little_and_may_come_twice(spark, tmp_path):
    from riskloom import streaming

    many = [(i, 1, f"card {i} " + "x" * 50) for i in range(20_000)]
    cards(spark, tmp_path, [many, [(i, 2, "new") for i in range(10)]], 32)
    size = lambda n: sum(p.stat().st_size for p in (tmp_path / "out" / "batches" / f"{n:012d}").glob("*.parquet"))
    assert size(1) * 10 < size(0)
    # The batch is delivered again, as after a crash: its folder is replaced.
    again = spark.createDataFrame([(i, 2, "new") for i in range(10)], "change_id long, ts long, card string")
    again.write.mode("overwrite").parquet(str(tmp_path / "out" / "batches" / f"{1:012d}"))
    got = streaming.read_latest_cards(spark, str(tmp_path / "out"))
    assert got.count() == 20_000 and got.where("card = 'new'").count() == 10


def test_a_delivery_counts_once_within_the_watermark(spark, tmp_path):
    from riskloom import streaming

    rows = [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:10:00", 1), ("b", "2024-01-01 00:05:00", 2)]
    spark.createDataFrame(rows, "bundle_id string, t string, n int").selectExpr("bundle_id", "timestamp(t) as ts", "n").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("bundle_id string, ts timestamp, n int").parquet(str(tmp_path / "in"))
    out = streaming.drop_repeats(src).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted((r.bundle_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 2)]
