"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and how often ids meet.

Both tokenizers take a text apart word by word (see wordwise), so groups, links and pairs of ids are worked out once for each
distinct word, by numpy. Most one-to-one groups join an id of A with the id of B that has the same bytes. These are known
from the vocabularies alone (the identity map) and are counted in a vector as long as A's vocabulary; only pairs of other
ids go through a shuffle, summed in each task before. The counts that links ask for then come back the same way: the vector
and A's highest counts are broadcast, as long as the vocabulary; so are up to KNOWN of the most frequent pairs; rarer pairs,
each held by few documents, meet their counts in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import wordwise
from riskloom.llm.shared import Scratch, blocks, named

#: Pairs that may be broadcast, 16 bytes each; words that a worker remembers; pairs that a task sums up at once.
KNOWN, REMEMBERED, SUMMED = 1 << 20, 1 << 18, 1 << 21
#: Links of a group up to which they are listed one by one.
LISTED = 4096


@dataclass
class Aligner:
    """Two tokenizers: functions from words after a space to ids (of A as bytes of 32-bit numbers), the bytes of each id, and the identity map: for each id of A
    an id of B with the same bytes, -1 if there is none (of two, the later one: byte pieces come first)."""

    a: object
    b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]

    def __post_init__(self):
        by_bytes = {x: i for i, x in enumerate(self.bytes_b)}
        self.same = np.array([by_bytes.get(x, -1) for x in self.bytes_a], np.int64)
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        text = lambda n, end: np.array([f"{i}{end}".encode() for i in range(n)], object)
        self.said = [text(len(self.bytes_a), ","), text(len(self.bytes_a), "|"), text(len(self.bytes_b), ","), text(len(self.bytes_b), ";")]
        self.words = wordwise.Remembered(self.aligned, REMEMBERED)

    def aligned(self, words: list[str]) -> list[tuple]:
        """For each word after a space: (n_a, n_b, groups, links, groups as text, distinct pairs, their links), the last two
        as bytes of 64-bit numbers, a pair being a * size of B + b; n_a is -1 if bytes of tokens aren't those of the text."""
        coded_a, coded_b = self.a(words), self.b(words)
        na, nb = np.array([len(x) >> 2 for x in coded_a]), np.array([len(x) for x in coded_b])
        a, b = np.frombuffer(b"".join(coded_a), "<u4").astype(np.int64), np.fromiter(chain.from_iterable(coded_b), np.int64, nb.sum())
        out = [(-1, 0, 0, 0, b"", b"", b"")] * len(words)
        fine = self._same_bytes([(" " + w).encode() for w in words], a, b, na, nb)
        good = np.flatnonzero(fine).tolist()
        if not good:
            return out
        if len(good) < len(words):
            a, b, na, nb = a[np.repeat(fine, na)], b[np.repeat(fine, nb)], na[fine], nb[fine]
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        word = np.searchsorted(np.cumsum(na), first_a, side="right")
        # Each token's text, in the order of groups, A before B in each.
        last_a, last_b = np.append(np.diff(group_a) > 0, True), np.append(np.diff(group_b) > 0, True)
        texts = np.empty(len(a) + len(b), object)
        texts[np.arange(len(a)) + first_b[group_a]] = np.where(last_a, self.said[1][a], self.said[0][a])
        texts[np.arange(len(b)) + first_a[group_b] + in_a[group_b]] = np.where(last_b, self.said[3][b], self.said[2][b])
        texts, cuts = texts.tolist(), np.cumsum(np.concatenate([[0], na + nb])).tolist()
        keys, links, owners = self._pairs(a, b, in_a, in_b, first_a, first_b, word)
        bounds = (np.searchsorted(owners, np.arange(len(good) + 1)) * 8).tolist()
        keys, links = keys.tobytes(), links.tobytes()
        groups, n_links = np.bincount(word, minlength=len(good)), np.bincount(word, in_a * in_b, len(good)).astype(np.int64)
        for k, i in enumerate(good):
            lo, hi = bounds[k], bounds[k + 1]
            out[i] = (int(na[k]), int(nb[k]), int(groups[k]), int(n_links[k]), b"".join(texts[cuts[k] : cuts[k + 1]])[:-1], keys[lo:hi], links[lo:hi])
        return out

    def _same_bytes(self, raw: list[bytes], a, b, na, nb) -> np.ndarray:
        """Whether the bytes of a word's tokens, of A and of B, are those of the word: for all at once, or else one by one."""
        fine = np.ones(len(raw), bool)
        for ids, n, names in ((a, na, self.bytes_a), (b, nb, self.bytes_b)):
            ends = np.cumsum(n)
            held = np.concatenate([[0], np.cumsum([len(names[i]) for i in ids.tolist()])])
            fine &= held[ends] - held[ends - n] == np.array([len(r) for r in raw])
            if not fine.all() or b"".join([names[i] for i in ids.tolist()]) != b"".join(raw):
                fine &= np.array([b"".join([names[i] for i in ids[e - k : e].tolist()]) == r for e, k, r in zip(ends.tolist(), n.tolist(), raw)], bool)
        return fine

    def _pairs(self, a, b, in_a, in_b, first_a, first_b, word) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each word, their links and the word, in the order of words."""
        n, few = len(self.bytes_b), in_a * in_b <= LISTED
        g = np.flatnonzero(few)
        at_a = wordwise.spread(first_a[g], in_a[g])
        owner = np.repeat(g, in_a[g])
        left = np.repeat(a[at_a], in_b[owner])
        right = b[wordwise.spread(first_b[owner], in_b[owner])]
        keys, links, words = [left * n + right], [np.ones(len(left), np.int64)], [np.repeat(word[owner], in_b[owner])]
        for g in np.flatnonzero(~few):
            x, cx = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            y, cy = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            keys.append((x[:, None] * n + y).ravel())
            links.append((cx[:, None] * cy).ravel())
            words.append(np.full(len(keys[-1]), word[g]))
        return summed(np.concatenate(keys), np.concatenate(links), np.concatenate(words))

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: n_a, n_b, groups and links (rows of four); the digest of its groups; and its distinct pairs, their
        links and the text's number, by text."""
        s = wordwise.split(pa.array(texts, pa.string()))
        found = list(self.words(s.words))
        # A text with a word whose bytes differ is looked at whole, as one word.
        bad = np.array([x[0] < 0 for x in found])
        odd = [i for i, t in enumerate(texts) if not t or bad[s.at[s.bounds[i] : s.bounds[i + 1]]].any()]
        whole = {i: self.aligned([texts[i]])[0] if texts[i] else (-1,) for i in odd}
        at = [s.at[s.bounds[i] : s.bounds[i + 1]] for i in range(len(texts))]
        for i, x in whole.items():
            at[i] = np.array([len(found)] if x[0] >= 0 else [], np.int64)
            found += [x] if x[0] >= 0 else []
        numbers = np.array([x[:4] for x in found], np.int64).reshape(-1, 4)
        said = [x[4] for x in found]
        digests = [hashlib.sha256(b";".join([said[j] for j in x.tolist()])).hexdigest() if len(x) else "" for x in at]
        doc = np.repeat(np.arange(len(at)), [len(x) for x in at])
        flat = np.concatenate(at) if at else np.zeros(0, np.int64)
        totals = np.zeros((len(at), 4), np.int64)
        for c in range(4):
            totals[:, c] = np.bincount(doc, numbers[flat, c], len(at))
        distinct, times = np.unique(doc * len(found) + flat, return_counts=True)
        doc, flat = np.divmod(distinct, max(len(found), 1))
        sizes = np.array([len(x[5]) >> 3 for x in found], np.int64)
        first = np.cumsum(sizes) - sizes
        keys, links = (np.frombuffer(b"".join([x[c] for x in found]), np.int64) for c in (5, 6))
        take = wordwise.spread(first[flat], sizes[flat])
        return (totals, digests, *summed(keys[take], links[take] * np.repeat(times, sizes[flat]), np.repeat(doc, sizes[flat])))


def summed(keys: np.ndarray, counts: np.ndarray, owners: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys (of each owner), in order, and the sums of their counts."""
    if owners is None:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[new], np.add.reduceat(counts, new) if len(new) else counts
    order = np.lexsort((keys, owners))
    keys, counts, owners = keys[order], counts[order], owners[order]
    new = np.flatnonzero((np.diff(keys, prepend=-1) != 0) | (np.diff(owners, prepend=-1) != 0))
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts, owners[new]


def byte_level_bytes(entries: list[str]) -> list[bytes]:
    """The bytes of a byte-level vocabulary's entries."""
    back = {c: b for b, c in enumerate(wordwise.byte_characters())}
    return [bytes(back[c] for c in e) for e in entries]


def piece_bytes(pieces: list[str], is_byte: list[bool]) -> list[bytes]:
    """The bytes of sentence pieces: UTF-8 with U+2581 as a space; a byte piece <0xHH> is that byte."""
    return [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, is_byte)]


@lru_cache(maxsize=2)
def aligner(raw_a: bytes, raw_b: bytes) -> Aligner:
    """A: the byte-level tokenizer of a file's bytes; B: the sentence-piece model of another's."""
    import sentencepiece

    left = wordwise.byte_level_tokenizer(raw_a, plain=True)
    right = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
    pieces = [right.id_to_piece(i) for i in range(right.get_piece_size())]
    if not wordwise.spaces_lead(pieces):
        raise ValueError("pieces with a space after another character can't be told word by word")
    lone = right.piece_to_id("▁")

    # Whole words are remembered with all that is known of them, so few stems need be.
    encode = wordwise.ByteLevel(left, most=REMEMBERED >> 2)

    def ids_b(words: list[str]) -> list[list[int]]:
        # The library puts its space before every word but an empty one.
        return [x if w else [lone] for w, x in zip(words, right.encode(words, num_threads=1))]

    names = [left.id_to_token(i) or "" for i in range(left.get_vocab_size())]
    return Aligner(encode, ids_b, byte_level_bytes(names), piece_bytes(pieces, [right.is_byte(i) for i in range(len(pieces))]))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of docs.

    A encodes a space and the text, B (which adds the space) the text, strings of special tokens being plain text. Bytes at
    which tokens of both end cut them into groups; a link is a token of A and one of B in one group. An id pair's count is
    the number of rows that hold it linked. n_best are the links whose count is the highest of their A id, count_sum adds
    up the counts of links. Null and empty texts, and those whose tokens' bytes aren't those of a space and the text, have
    no tokens: zeros and an empty digest. Rows that repeat an id count each; other columns are left behind.
    """
    spark = docs.sparkSession
    raw = []
    for path in (path_a, path_b):
        with open(path, "rb") as f:
            raw.append(f.read())
    shipped = spark.sparkContext.broadcast(tuple(raw))
    scratch, result = Scratch(spark, "align"), Scratch(spark, "aligned")
    lists = ["same", "same_links", "pairs", "pair_links"]

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = aligner(*shipped.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for lo, hi in blocks([len(t or "") for t in texts], wordwise.BLOCK >> 1):
                totals, digests, keys, links, doc = own.documents(texts[lo:hi])
                same = own.same[keys // len(own.bytes_b)] == keys % len(own.bytes_b)
                cols = [pa.array(range(row, row + hi - lo), pa.int64()), ids.slice(lo, hi - lo), *[pa.array(totals[:, c]) for c in range(4)], pa.array(digests)]
                for keep, values in ((same, (keys // len(own.bytes_b)).astype(np.int32)), (same, links), (~same, keys), (~same, links)):
                    bounds = np.searchsorted(doc[keep], np.arange(hi - lo + 1)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(values[keep])))
                row += hi - lo
                yield pa.RecordBatch.from_arrays(cols, names + lists)

    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    numbers = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    d = docs.select(named(id_col)[0].cast("long").alias("id"), named(text_col)[0].alias("t"))
    rows = scratch.cut(d.mapInArrow(taken_apart, f"{numbers}, same array<int>, same_links array<bigint>, pairs array<bigint>, pair_links array<bigint>"), "rows")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*shipped.value)
        vector, held, n = np.zeros(len(own.bytes_a), np.int64), [], 0
        for batch in batches:
            vector += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(vector))
            keys = batch.column(1).flatten().to_numpy()
            for lo in range(0, len(keys), SUMMED):
                held.append(summed(keys[lo : lo + SUMMED], np.ones(min(SUMMED, len(keys) - lo), np.int64)))
                n += len(held[-1][0])
                if n >= SUMMED:
                    held = [summed(*map(np.concatenate, zip(*held)))]
                    if (n := len(held[0][0])) >= SUMMED >> 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["pair", "n"])
                        n = 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(*map(np.concatenate, zip(*held)))], ["pair", "n"])
        seen = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - seen), pa.array(vector[seen])], ["pair", "n"])

    own = aligner(*raw)
    n_b = len(own.bytes_b)
    counts = scratch.cut(rows.select("same", "pairs").mapInArrow(counted, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("c")), "counts")

    # As long as A's vocabulary: counts of the identity map (negative keys), and each A id's highest count.
    a_id = F.when(F.col("pair") < 0, -1 - F.col("pair")).otherwise(F.floor(F.col("pair") / n_b)).cast("long")
    top = counts.groupBy(a_id.alias("a")).agg(F.max("c").alias("best"), F.max(F.when(F.col("pair") < 0, F.col("c"))).alias("c")).toArrow()
    vector, best = np.zeros(len(own.bytes_a), np.int64), np.zeros(len(own.bytes_a), np.int64)
    best[top.column("a").to_numpy()] = top.column("best").to_numpy()
    vector[top.column("a").to_numpy()] = top.column("c").fill_null(0).to_numpy()
    # The most frequent pairs, down to a power of two that at most KNOWN reach.
    least, total = None, 0
    levels = counts.where("pair >= 0").groupBy(F.floor(F.log2("c")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect()
    for level, n in levels:
        total += n
        if total > KNOWN:
            break
        least = 1 << level
    all_known = total <= KNOWN
    often = counts.where((F.col("pair") >= 0) & (F.col("c") >= (least or 0))).orderBy("pair").toArrow() if least else None
    keys, values = (np.zeros(0, np.int64),) * 2 if often is None else (often.column(c).to_numpy() for c in ("pair", "c"))
    sent = spark.sparkContext.broadcast((vector, best, keys, values))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, best, keys, values = sent.value
        for batch in batches:
            size = batch.num_rows
            get = lambda c: batch.column(c).flatten().to_numpy()
            doc = [np.repeat(np.arange(size), batch.column(c).value_lengths().to_numpy()) for c in (0, 2)]
            same, pairs = get(0), get(2)
            place = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
            c = np.concatenate([vector[same], values[place[known]]])
            a, links, owner = np.concatenate([same, pairs[known] // n_b]), np.concatenate([get(1), get(3)[known]]), np.concatenate([doc[0], doc[1][known]])
            sums, bests = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(sums, owner, links * c)
            np.add.at(bests, owner, links * (c == best[a]))
            bounds = pa.array(np.searchsorted(doc[1][~known], np.arange(size + 1)).astype(np.int32))
            cols = [*batch.columns[4:], pa.array(bests), pa.array(sums), *[pa.ListArray.from_arrays(bounds, pa.array(x[~known])) for x in (pairs, get(3))]]
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_best", "count_sum", "pairs", "pair_links"])

    found = rows.select(*lists, *names).mapInArrow(looked_up, f"{numbers}, n_best bigint, count_sum bigint, pairs array<bigint>, pair_links array<bigint>")
    if not all_known:
        found = scratch.cut(found, "found")
        highest = spark.createDataFrame([(i, int(x)) for i, x in enumerate(best) if x], "a long, best long")
        rare = counts.where(F.col("pair") >= 0) if least is None else counts.where((F.col("pair") >= 0) & (F.col("c") < least))
        rare = rare.withColumn("a", F.floor(F.col("pair") / n_b).cast("long")).join(highest, "a")
        asked = found.select("row", F.explode(F.arrays_zip("pairs", "pair_links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.pair_links").alias("links"))
        more = asked.join(rare, "pair").groupBy("row").agg(F.sum(F.col("links") * F.col("c")).alias("s"), F.sum(F.when(F.col("c") == F.col("best"), F.col("links")).otherwise(0)).alias("b"))
        found = found.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0))})
    out = result.cut(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "result")
    scratch.drop()
    return out
