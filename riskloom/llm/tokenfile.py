"""Token ids in binary files of fixed-width bit packing.

A file holds whole documents in ascending order: HEAD, a table of documents, offsets of blocks and the blocks. An id takes
the fewest bits that the vocabulary needs; a block of BLOCK_IDS ids starts at a byte, so the ids of any range are unpacked by
numpy from the blocks that hold them. Spark writes the files (a row of bytes each) and reads them again, so they can be in
any store that Spark reaches: rows are dealt by range of the document's id, encoded where they arrive, and file names are
in the order of the documents.

Encoding needs the tokenizers library, so rows go through Arrow batches; a file is built from at most about FILE_IDS ids,
or one longer document. The tokenizer's file is broadcast, a fixed size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import wordwise
from riskloom.llm.shared import blocks, named

#: Fixed values of the format: its name, and the numbers that follow it (width, ids of a block, part, number of the file
#: in its part, ids of the part before the file, documents, ids, blocks).
MAGIC, HEAD = b"RLBITS01", struct.Struct("<8s8q")
BLOCK_IDS = 4096
#: Ids of a file, about, and bytes of text in a range of documents, about.
FILE_IDS, PART_BYTES = 1 << 22, 1 << 28


def width_of(vocabulary: int) -> int:
    """The fewest bits for ids below `vocabulary`, one at least."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids one after the other in `width` bits each, lowest bits first; the last byte is filled with zeros."""
    if width % 8 == 0:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : width // 8]).tobytes()
    out = []
    for i in range(0, len(ids), 1 << 16):
        bits = (ids[i : i + (1 << 16), None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(raw: np.ndarray, width: int, count: int, start: int = 0) -> np.ndarray:
    """`count` ids of packed bytes from the one with number `start` on, as 32-bit numbers."""
    if width % 8 == 0:
        out = np.zeros((count, 4), np.uint8)
        out[:, : width // 8] = raw[start * width // 8 : (start + count) * width // 8].reshape(count, width // 8)
        return out.view("<u4").ravel()
    at = (start + np.arange(count, dtype=np.int64)) * width
    padded = np.concatenate([raw[(at[0] >> 3) : (at[-1] >> 3) + 5], np.zeros(5, np.uint8)]) if count else raw
    byte = (at >> 3) - (at[0] >> 3) if count else at
    word = sum((padded[byte + i].astype(np.uint64) << np.uint64(8 * i) for i in range(5)), np.zeros(count, np.uint64))
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], width: int, part: int = 0, nth: int = 0, before: int = 0) -> bytes:
    """A file of the documents in this order."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    if len(every) and int(every.max()) >> width:
        raise ValueError(f"an id does not fit into {width} bits")
    packed = [pack(every[i : i + BLOCK_IDS], width) for i in range(0, len(every), BLOCK_IDS)]
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], "<i8")
    firsts = np.cumsum([0, *[len(x) for x in ids]]).astype("<i8")
    offsets = np.cumsum([0, *[len(x) for x in packed]]).astype("<i8")
    head = HEAD.pack(MAGIC, width, BLOCK_IDS, part, nth, before, len(ids), len(every), len(packed))
    return b"".join([head, names.tobytes(), firsts.tobytes(), offsets.tobytes(), known.tobytes(), *packed])


@dataclass
class TokenFile:
    """A view of a file's bytes. Only the blocks that hold the ids asked for are unpacked."""

    raw: bytes

    def __post_init__(self):
        magic, self.width, self.block_ids, self.part, self.nth, self.before, self.n_docs, self.n_ids, self.n_blocks = HEAD.unpack_from(self.raw)
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        at = HEAD.size
        self.names, self.firsts, self.offsets = (np.frombuffer(self.raw, "<i8", n, at + 8 * skip) for n, skip in ((self.n_docs, 0), (self.n_docs + 1, self.n_docs), (self.n_blocks + 1, 2 * self.n_docs + 1)))
        self.known = np.frombuffer(self.raw, np.uint8, self.n_docs, at + 8 * (2 * self.n_docs + self.n_blocks + 2))
        self.body = at + 8 * (2 * self.n_docs + self.n_blocks + 2) + self.n_docs

    @cached_property
    def doc_ids(self) -> list[int | None]:
        return [x if k else None for x, k in zip(self.names.tolist(), self.known.tolist())]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids with the numbers start to stop - 1 of the file."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        lo, hi = start // self.block_ids, -(-stop // self.block_ids)
        raw = np.frombuffer(self.raw, np.uint8, self.offsets[hi] - self.offsets[lo], self.body + self.offsets[lo])
        return unpack(raw, self.width, stop - start, start - lo * self.block_ids)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.firsts[i + 1]))


@lru_cache(maxsize=2)
def _encoders(raw: bytes):
    """Two functions from words to ids, for words after a space and for first words; the vocabulary's size."""
    tokenizer = wordwise.byte_level_tokenizer(raw, plain=False)
    return wordwise.Remembered(wordwise.ByteLevel(tokenizer)), wordwise.Remembered(wordwise.ByteLevel(tokenizer, "", 1 << 16), 1 << 16), tokenizer.get_vocab_size()


def encode(texts: pa.Array, raw: bytes) -> list[np.ndarray]:
    """The ids of each text as the library gives them without added special tokens."""
    after_space, first, _ = _encoders(raw)
    s = wordwise.split(texts)
    starts = first([s.words[i] for i in s.at[s.bounds[:-1]]])
    coded = after_space(s.words)
    counts = np.array([len(x) >> 2 for x in coded], np.int64)
    flat, begin = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(counts) - counts
    out = []
    for i, head in enumerate(starts):
        at = s.at[s.bounds[i] + 1 : s.bounds[i + 1]]
        out.append(np.concatenate([np.frombuffer(head, "<u4"), flat[wordwise.spread(begin[at], counts[at])]]))
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of docs, encoded whole by the tokenizer of a file, each with end_id after it, into `path`.

    Documents stand in ascending order of their ids (null first); rows that repeat an id stand in the order of their
    texts' hashes. A null text is empty and has end_id alone. No documents make no file. Other columns are left behind.
    """
    with open(tokenizer, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    width = width_of(max(_encoders(raw.value)[2], end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, before = TaskContext.get().partitionId(), 0, 0
        names, ids, held = [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file_bytes(names, ids, width, part, nth, before)], pa.binary())], ["raw"])

        for batch in batches:
            sizes = wordwise.pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for lo, hi in blocks(sizes, wordwise.BLOCK):
                for name, own in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), encode(batch.column(1).slice(lo, hi - lo), raw.value)):
                    names.append(name)
                    ids.append(np.append(own, np.uint32(end_id)))
                    held += len(ids[-1])
                    if held >= FILE_IDS:
                        yield full()
                        names, ids, held, nth, before = [], [], 0, nth + 1, before + held
        if names:
            yield full()

    d = docs.select(named(id_col)[0].cast("long").alias("id"), F.coalesce(named(text_col)[0], F.lit("")).alias("t"))
    size = d.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    # The row's number keeps rows that repeat an id and a text from being one key.
    keys = ("id", "h", "nth")
    dealt = d.withColumn("h", F.xxhash64("t")).withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    files = dealt.select("id", "t").mapInArrow(run, "raw binary")
    files.select(F.col("raw").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def documents(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, part, start_in_part, n_tokens, ids_crc32, file and, if asked for, ids (array<int>) of every document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                f = TokenFile(content.as_buffer().to_pybytes())
                for lo in range(0, f.n_docs, 1024):
                    own = [f.document(i) for i in range(lo, min(lo + 1024, f.n_docs))]
                    cols = [pa.array(f.doc_ids[lo : lo + 1024], pa.int64()), pa.array([f.part] * len(own), pa.int64()), pa.array(f.before + f.firsts[lo : lo + len(own)]), pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()), pa.array([name.as_py()] * len(own), pa.string())]
                    yield pa.RecordBatch.from_arrays(cols + ([pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))] if keep_ids else []), names)

    names = ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32", "file"] + ["ids"] * keep_ids
    schema = "doc_id bigint, part bigint, start_in_part bigint, n_tokens bigint, ids_crc32 bigint, file string" + ", ids array<int>" * keep_ids
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, schema)


def with_starts(rows: DataFrame) -> DataFrame:
    """rows of `documents` with start: the ids of all documents before each. Parts are as many as write_tokens dealt out, so
    their totals are few."""
    totals = sorted(rows.groupBy("part").agg(F.sum("n_tokens")).collect())
    begins = np.cumsum([0, *[n for _, n in totals]])
    base = rows.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, begins)], "part long, _base long")
    return rows.join(base, "part").withColumn("start", F.col("_base") + F.col("start_in_part")).drop("_base")


def read_range(spark: SparkSession, path: str, index: DataFrame, start: int, stop: int) -> np.ndarray:
    """The ids with the numbers start to stop - 1 of all files together: of index (see with_starts), the files of that range
    are picked, and of these the blocks that hold it are unpacked."""
    hit = index.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    files = hit.groupBy("file").agg(F.min("start").alias("first"), F.min(F.struct("start", "start_in_part")).alias("s")).orderBy("first").collect()
    out = [np.zeros(0, "<u4")]
    for row in files:
        f = TokenFile(bytes(spark.read.format("binaryFile").load(row["file"]).first()["content"]))
        begin = row["s"]["start"] - (row["s"]["start_in_part"] - f.before)
        out.append(f.ids(start - begin, stop - begin))
    return np.concatenate(out)
