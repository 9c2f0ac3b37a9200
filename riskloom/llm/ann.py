"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

Every vector gets one more coordinate so that all have one length, which turns the largest inner product into the least
Euclidean distance. A table hashes with a few Gaussian projections, each floor((a . x + b) / w). A query visits perturbed
buckets in the order of their estimated chance of holding a neighbour, until the chances add up to REACH; the distance of
its neighbours, which the chances depend on, is estimated from a bounded sample of the rows. What the tables find is
merged and ranked by the exact inner product.

Equal vectors are one class in the index with its smallest ids, as many as a query can return. Classes and queries meet in
blocks of bounded size: small buckets share a block, a large one has several, so a crowded bucket is no hot task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import cut

TABLES, REACH, SAMPLE, SEED = 2, 0.85, 2_000, 7
#: Classes and queries of a block, about; and the bucket size that sets the number of projections.
BLOCK, QUERIES, BUCKET = 16_384, 1_024, 1_024


@dataclass
class Index:
    """Projections (tables x k x dim + 1), offsets, bucket width, the common length of vectors, rows, and the sample."""

    a: np.ndarray
    b: np.ndarray
    width: float
    length: float
    rows: int
    sample: np.ndarray

    def place(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Projections in bucket widths, tables x rows x k. A query's last coordinate is 0."""
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.length**2 - (x * x).sum(axis=1), 0))
        return (np.concatenate([x, last[:, None]], axis=1) @ self.a.transpose(0, 2, 1) + self.b[:, None, :]) / self.width


def bucket_key(table: int, cells: np.ndarray) -> np.ndarray:
    """One long for each row of cell numbers."""
    h = np.full(len(cells), table + 1, np.uint64)
    for column in cells.astype(np.int64).view(np.uint64).T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def probes(place: np.ndarray, spread: float, reach: float) -> Iterator[tuple[tuple[int, ...], float]]:
    """Cells around a query's place and their chances, most likely first, until the chances add up to reach.

    A neighbour's place differs from the query's by a normal deviate of standard deviation spread in every coordinate.
    """
    cdf = NormalDist(0, max(spread, 1e-9)).cdf
    choices = []
    for p in place:
        at = math.floor(p)
        far = max(1, math.ceil(4 * spread))
        cells = [(cdf(c + 1 - p) - cdf(c - p), c) for c in range(at - far, at + far + 1)]
        choices.append(sorted((x for x in cells if x[0] > 0 or x[1] == at), key=lambda x: (-x[0], x[1])))
    start = (0,) * len(place)
    chance = lambda s: math.prod(c[i][0] for c, i in zip(choices, s))
    heap, seen, total = [(-chance(start), start)], {start}, 0.0
    while heap and total < reach:
        p, s = heapq.heappop(heap)
        total -= p
        yield tuple(c[i][1] for c, i in zip(choices, s)), -p
        for d in range(len(s)):
            t = (*s[:d], s[d] + 1, *s[d + 1 :])
            if s[d] + 1 < len(choices[d]) and t not in seen:
                seen.add(t)
                heapq.heappush(heap, (-chance(t), t))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and x (array<double>) of the rows that take part: an id, and a vector without null or non-finite components that
    isn't zero."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return v.where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(F.exists("x", bad), F.lit(False)) & F.exists("x", lambda c: c != 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build(classes: DataFrame) -> Index:
    """Fits the hash functions: sizes from all rows, the sample from those with the smallest hashes of their ids."""
    n, longest = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)))).first()
    sample = _matrix(classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("x").toArrow().column(0))
    k = max(2, round(math.log2(max(n / BUCKET, 1)) / 1.4))
    rng = np.random.default_rng(SEED)
    width = 2.0 * longest
    return Index(rng.standard_normal((TABLES, k, sample.shape[1] + 1)), rng.uniform(0, width, (TABLES, k)), width, longest, n, sample)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", reach: float = REACH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's `top` largest inner products found, its own id left out.

    queries are rows of vectors. Ties go to the smaller id. Fewer rows come back only where fewer are candidates: a
    query for which the buckets visited hold too few visits all of them. Rows that take no part (see usable) are neither
    queries nor candidates; rows that repeat an id and a vector are candidates each. Vectors of one length are candidates
    of queries of that length: each length that queries have is a search of its own.
    """
    v, asked = cut(usable(vectors, id_col, vec_col), "vectors"), cut(usable(queries, id_col, vec_col).distinct(), "asked")
    lengths = [r[0] for r in asked.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]
    out = v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in lengths:
        out = out.unionByName(_of_one_length(v.where(F.size("x") == d), asked.where(F.size("x") == d), top, reach))
    return out


def _of_one_length(v: DataFrame, asked_rows: DataFrame, top: int, reach: float) -> DataFrame:
    order = Window.partitionBy("x").orderBy("id")
    first = v.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top + 1)
    classes = cut(first.groupBy("x").agg(F.min("id").alias("cid"), F.array_sort(F.collect_list("id")).alias("ids")), "classes")
    if not classes.take(1):
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build(classes)
    q = cut(asked_rows.join(classes.select("x", "cid"), "x").select(F.col("id").alias("query_id"), F.col("cid").alias("qcid")), "queries")
    asked = cut(q.select(F.col("qcid").alias("cid")).distinct().join(classes.select("cid", "x"), "cid"), "asked")
    found = cut(_search(classes.select("cid", "x"), asked, index, top + 1, reach), "found")
    # A query short of candidates goes through all buckets.
    enough = found.join(classes.select("cid", F.size("ids").alias("_n")), "cid").groupBy("qcid").agg(F.sum("_n").alias("_n")).where(F.col("_n") > top).select(F.col("qcid").alias("cid"))
    rest = cut(asked.join(enough, "cid", "left_anti"), "short")
    if rest.take(1):
        found = found.join(rest.select(F.col("cid").alias("qcid")), "qcid", "left_anti").unionByName(_search(classes.select("cid", "x"), rest, index, top + 1, math.inf))
    pairs = q.join(found, "qcid").join(classes.select("cid", "ids"), "cid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _search(classes: DataFrame, asked: DataFrame, index: Index, top: int, reach: float) -> DataFrame:
    """qcid, cid, score: the best `top` classes of each asked class, itself included, among the buckets that it visits,
    or among all classes if reach is infinite."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(index.place(_matrix(batch.column(1))))
                for t in range(len(cells)):
                    yield pa.RecordBatch.from_arrays([pa.array(bucket_key(t, cells[t])), *batch.columns], ["bucket", "cid", "x"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = NormalDist().inv_cdf(min(max(1 - (top - 1) / max(index.rows, top + 1), 0.5), 1 - 1e-12))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            own = x @ index.sample.T
            score = own.mean(axis=1) + z * own.std(axis=1)
            spread = np.sqrt(np.maximum((x * x).sum(axis=1) + index.length**2 - 2 * score, 1e-12)) / index.width
            place = index.place(x, query=True)
            for i, cid in enumerate(batch.column(0).to_pylist()):
                for t in range(len(place)):
                    cells = np.array([c for c, _ in probes(place[t, i], float(spread[i]), reach)])
                    yield pa.RecordBatch.from_arrays([pa.array([cid] * len(cells), pa.int64()), pa.array(bucket_key(t, cells))], ["qcid", "bucket"])

    rows = classes.mapInArrow(hashed, "bucket bigint, cid bigint, x array<double>")
    sizes = rows.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    groups = max(1, math.ceil(TABLES * index.rows / BLOCK))
    block = F.pmod(F.xxhash64("bucket"), F.lit(groups)).cast("int").alias("block")
    placed = rows.join(sizes, "bucket").select(block, F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), "bucket", "cid", "x")
    if math.isfinite(reach):
        seen = asked.mapInArrow(visits, "qcid bigint, bucket bigint").join(sizes, "bucket").select("qcid", "bucket", block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        seen = cut(seen.groupBy("block", "part", "qcid").agg(F.collect_list("bucket").alias("buckets")), "seen")
    else:
        placed = classes.select(F.pmod(F.xxhash64("cid"), F.lit(groups)).cast("int").alias("block"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("bucket"), "cid", "x")
        seen = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("block"), F.lit(0).alias("part"), F.col("cid").alias("qcid"), F.array(F.lit(0).cast("long")).alias("buckets"))
    # A block's rows go once to each chunk of about QUERIES of the queries that visit it, and nowhere if none does.
    chunks = cut(seen.groupBy("block", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks")), "chunks")
    wanted = seen.join(chunks, ["block", "part"]).join(asked.select(F.col("cid").alias("qcid"), "x"), "qcid").withColumn("chunk", F.pmod(F.xxhash64("qcid"), F.col("chunks")).cast("int")).drop("chunks")
    placed = placed.join(chunks, ["block", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and rows.num_rows:
            bucket, cid, x = rows.column("bucket").to_numpy(), rows.column("cid").to_numpy(), _matrix(rows.column("x"))
            names, at = np.unique(bucket, return_inverse=True)
            qcid, asked_x = queries.column("qcid").to_numpy(), _matrix(queries.column("x"))
            lists = queries.column("buckets").combine_chunks()
            for lo in range(0, len(qcid), 128):
                part = lists.slice(lo, 128)
                who = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                what = np.searchsorted(names, part.flatten().to_numpy())
                what = np.where(what < len(names), what, 0)
                visit = np.zeros((len(part), len(names)), bool)
                same = names[what] == part.flatten().to_numpy()
                visit[who[same], what[same]] = True
                score = np.where(visit[:, at], asked_x[lo : lo + 128] @ x.T, -np.inf)
                for i, s in enumerate(score):
                    least = np.partition(s, -top)[-top] if len(s) > top else -np.inf
                    best = np.flatnonzero((s >= least - 1e-9) & (s > -np.inf))
                    out.append((np.full(len(best), qcid[lo + i]), cid[best], (x[best] * asked_x[lo + i]).sum(axis=1)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"qcid": pa.array(columns[0], pa.int64()), "cid": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    keys = ("block", "part", "chunk")
    merged = wanted.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(meet, "qcid bigint, cid bigint, score double").distinct()
    # A class's smallest id stands for it: rows of later classes come after those of the first `top` in any case.
    rank = Window.partitionBy("qcid").orderBy(F.desc("score"), "cid")
    return merged.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= top).drop("_n")
