"""Ranked lexical search by the Best Position Algorithm.

Items are taken in blocks of bounded vocabulary. For each block one scan of the documents keeps, of every document, its length
and how often it holds each of the block's terms; corpus counts come from these rows, which are written to the shared folder.
Then every task turns the rows it reads into shards of impact lists, one for each term, best first, and runs the Best
Position Algorithm (Akbarinia, Pacitti and Valduriez, 2007) for every item: lists are read from the top in parallel; a
document that shows up is looked up directly in all other lists, and its places there count as seen. A list's best
position is the last one before which all have been seen; a document not seen yet scores no more than the impacts at the best
positions add up to. An item is done once that is strictly below its k-th score, so that ties at the k-th are all seen.

A shard sends at most k rows of each item on, so a frequent term is no hot key: its list is as split as the documents are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import Scratch, named

#: Bytes that belong to no term; letters A-Z are lower-cased.
GAPS = bytes(b for b in range(0x80) if not (chr(b).isdigit() or chr(b).isalpha()))
LOWER = bytes.maketrans(GAPS + bytes(range(ord("A"), ord("Z") + 1)), b" " * len(GAPS) + bytes(range(ord("a"), ord("z") + 1)))
#: Term occurrences of a block of items, about; postings of a shard, about; places of each list that the first round reads.
ITEM_TERMS, POSTINGS, FIRST = 1 << 18, 1 << 20, 16


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order: runs of ASCII letters, digits and all that isn't ASCII."""
    return (text or "").encode().translate(LOWER).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, in 64-bit integers."""
    m = 100 - 25 + (25 * length * n_docs) // max(total, 1)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


@dataclass
class Lists:
    """Impact lists of a shard. A posting has a number by document (by_doc tells where each document's begin) and a place in
    the lists (by_term tells where each term's begin); place maps numbers to places."""

    doc: np.ndarray
    impact: np.ndarray
    by_term: np.ndarray
    place: np.ndarray
    by_doc: np.ndarray
    term: np.ndarray

    @staticmethod
    def of(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int) -> Lists:
        """From postings in the order of documents."""
        order = np.lexsort((-impact, term))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return Lists(doc[order], impact[order], np.searchsorted(term[order], np.arange(n_terms + 1)), place, np.searchsorted(doc, np.arange(n_docs + 1)), term)


@dataclass
class Work:
    """How far a search got: postings read from the top, direct lookups, and postings of the item's lists."""

    read: int = 0
    direct: int = 0
    postings: int = 0


def best_positions(lists: Lists, item_terms: np.ndarray, times: np.ndarray, k: int, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents (by number in the shard) and scores of all that may be among the k best for distinct terms and the times each
    is asked for: at least every document that scores as much as the k-th."""
    starts, stops = lists.by_term[item_terms], lists.by_term[item_terms + 1]
    factor = np.zeros(len(lists.by_term) - 1, np.int64)
    factor[item_terms] = times
    seen = np.zeros(len(lists.doc), bool)
    known = np.zeros(len(lists.by_doc) - 1, bool)
    best = starts.copy()
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, step, longest = 0, FIRST, int((stops - starts).max(initial=0))
    while depth < longest:
        # Sorted access: the next places of every list.
        lo, hi = np.minimum(starts + depth, stops), np.minimum(starts + depth + step, stops)
        at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
        seen[at] = True
        fresh = np.unique(lists.doc[at])
        fresh = fresh[~known[fresh]]
        known[fresh] = True
        # Direct access: all postings of the documents that are new.
        n = lists.by_doc[fresh + 1] - lists.by_doc[fresh]
        own = np.repeat(lists.by_doc[fresh] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner, times_of = np.repeat(np.arange(len(fresh)), n), factor[lists.term[own]]
        asked = times_of > 0
        where = lists.place[own[asked]]
        seen[where] = True
        score = np.zeros(len(fresh), np.int64)
        np.add.at(score, owner[asked], times_of[asked] * lists.impact[where])
        docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, score])
        if work:
            work.read, work.direct = work.read + len(at), work.direct + len(where)
        # Best positions, and what a document not seen yet may score at most.
        bound = 0
        for i in range(len(best)):
            if best[i] < stops[i]:
                unseen = np.flatnonzero(~seen[best[i] : stops[i]])
                best[i] = best[i] + unseen[0] if len(unseen) else stops[i]
                bound += int(times[i]) * int(lists.impact[best[i] - 1]) if len(unseen) else 0
        if len(scores) >= k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= kth
            docs, scores = docs[keep], scores[keep]
            if bound < kth:
                break
        depth, step = depth + step, step * 2
    if work:
        work.postings += int((stops - starts).sum())
    return docs[scores > 0], scores[scores > 0]


def search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `top` documents of the highest score above 0 for every row of items.

    Every row of docs is a document and every row of items an item, repeated ids or not; ranks are within an item's row,
    equal scores by ascending doc_id (null last), then in a fixed order of rows. Null texts have no terms; an item without
    terms, or whose terms no document holds, has no rows. Other columns are left behind.
    """
    spark = docs.sparkSession
    scratch, result = Scratch(spark, "lexical"), Scratch(spark, "ranked")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(terms(text))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), pa.array([list(found)], pa.list_(pa.binary())), pa.array([list(found.values())], pa.list_(pa.int64()))], ["item", "terms", "times"])

    asked = items.select(named(item_col)[0].cast("long").alias("i"), named(item_text_col)[0].alias("t")).mapInArrow(listed, "item bigint, terms array<binary>, times array<bigint>")
    asked = scratch.cut(asked.withColumn("key", F.monotonically_increasing_id()), "items")
    n_blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // ITEM_TERMS)
    found = [_searched(docs.select(named(id_col)[0].cast("long").alias("i"), named(text_col)[0].alias("t")), asked.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == b), top, scratch) for b in range(n_blocks)]
    schema = "key long, item_id long, row long, doc_id long, score long"
    every = spark.createDataFrame([], schema) if not found else found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    out = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
    out = result.cut(out, "result")
    scratch.drop()
    return out


def _searched(docs: DataFrame, block: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """key, item_id, row, doc_id, score: of every shard the best rows of each item of a block, a bounded number of items."""
    spark = docs.sparkSession
    table = block.orderBy("key").toArrow()
    lists = table.column("terms").to_pylist()
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for own in lists for t in own))}
    keys, names = table.column("key").to_pylist(), table.column("item").to_pylist()
    wanted = [(np.array([vocabulary[t] for t in own], np.int64), np.array(times, np.int64)) for own, times in zip(lists, table.column("times").to_pylist())]
    sent = spark.sparkContext.broadcast((vocabulary, wanted))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, row = sent.value[0], TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows, ids, lengths, sizes, which, tf = [], [], [], [0], [], []
                for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    row += 1
                    if own := terms(text):
                        held = [(vocabulary[t], c) for t, c in Counter(own).items() if t in vocabulary]
                        rows.append(row)
                        ids.append(ident)
                        lengths.append(len(own))
                        which += [t for t, _ in held]
                        tf += [c for _, c in held]
                        sizes.append(len(which))
                bounds = pa.array(sizes, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(which, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(tf, pa.int64()))], ["row", "doc_id", "n", "terms", "tf"])

    held = scratch.cut(docs.mapInArrow(scanned, "row bigint, doc_id bigint, n bigint, terms array<int>, tf array<bigint>"), "held")
    n_docs, total = (x or 0 for x in held.agg(F.count("*"), F.sum("n")).first())
    # As long as the block's vocabulary.
    df = held.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    weights = np.zeros(len(vocabulary), np.int64)
    weights[df.column("t").to_numpy()] = [weight(n_docs, x) for x in df.column("count").to_pylist()]
    weighed = spark.sparkContext.broadcast(weights)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, wanted = weighed.value, sent.value[1]

        def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows, ids, n, which, tf = (pa.chunked_array([p.column(c) for p in parts]).combine_chunks() for c in range(5))
            doc = np.repeat(np.arange(len(rows)), which.value_lengths().to_numpy())
            t, tf = which.flatten().to_numpy(), tf.flatten().to_numpy()
            own = Lists.of(doc, t.astype(np.int64), impacts(weights[t], tf, n.to_numpy()[doc], n_docs, total), len(rows), len(weights))
            out, rows, ids = [], rows.to_numpy(), ids.to_pylist()
            for i, (item_terms, times) in enumerate(wanted):
                d, s = best_positions(own, item_terms, times, top)
                # The shard's own k best, in the order of the result.
                best = sorted(((-int(s[x]), ids[d[x]] is None, ids[d[x]] or 0, int(rows[d[x]])) for x in np.argsort(-s, kind="stable")))[:top]
                out += [(keys[i], names[i], row, None if no_id else ident, -score) for score, no_id, ident, row in best]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], ["key", "item_id", "row", "doc_id", "score"])

        parts, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 12):
                parts.append(batch.slice(lo, 1 << 12))
                size += len(parts[-1].column(3).flatten())
                if size >= POSTINGS:
                    yield shard(parts)
                    parts, size = [], 0
        if size:
            yield shard(parts)

    return held.where(F.size("terms") > 0).mapInArrow(ranked, "key bigint, item_id bigint, row bigint, doc_id bigint, score bigint")
