"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Python is needed for the library, so batches of rows go through Arrow and every text is encoded by itself. A long text is
cut before white space that follows something else: no match of the splitting pattern reaches from there into white
space, so the pieces give the ids of the whole text. White space that goes on for RUN characters or more is one match of
the pattern up to its last character (all of it at the end of the text), and is encoded as such: the library's search
would run out of stack there. The driver reads the rank file and broadcasts its bytes, a fixed size.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A place to cut: before one of the white space characters that all libraries know, after anything else.
CUT = re.compile(r"(?<=\S)(?=[ \t\n])")
PIECE, RUN = 1 << 16, 1 << 12
#: White space as the library's patterns know it: Unicode's property of that name.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


def encoder(path: str, pattern: str):
    """The encoding of a rank file."""
    with open(path, "rb") as f:
        return _encodings(f.read(), pattern)[0]


@functools.lru_cache(maxsize=4)
def _encodings(raw: bytes, pattern: str) -> tuple:
    """The encoding of the bytes of a rank file, and one that takes a text as one match; kept by the worker process."""
    import tiktoken

    ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, raw.splitlines())}
    return tuple(tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for name, p in (("local", pattern), ("whole", r"[\s\S]+")))


def safe_pieces(text: str, piece: int = PIECE) -> Iterator[str]:
    """Pieces of at least `piece` characters, cut at the first safe place after that; joined they are the text."""
    start = 0
    while len(text) - start > piece:
        found = CUT.search(text, start + piece)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(text: str | None, encodings: tuple, piece: int = PIECE) -> list[int]:
    """The ids of a whole text without special tokens; a null text is empty."""
    by_match, whole = encodings
    text, start, ids = text or "", 0, []
    for run in LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        for part in safe_pieces(text[start : run.start()], piece):
            ids += by_match.encode_ordinary(part)
        ids += whole.encode_ordinary(text[run.start() : end])
        start = end
    for part in safe_pieces(text[start:], piece):
        ids += by_match.encode_ordinary(part)
    return ids


def _shipped(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep_ids: bool = True, digests: bool = False, piece: int = PIECE) -> DataFrame:
    """Adds n_tokens and ids (array<int>, unless keep_ids is off) to docs; with digests also the SHA-256 of the decimal
    ids joined by a space and of the bytes that the ids decode to.

    Null and empty texts have no ids. Columns of docs named like an added one are replaced.
    """
    added = ["n_tokens"] + ["ids"] * keep_ids + ["ids_sha256", "decoded_sha256"] * digests
    kept = docs.drop(*added)
    types = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    out = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{c} {types[c]}" for c in added])

    raw = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encodings = _encodings(raw.value, pattern)
        enc = encodings[0]
        words = [str(i) for i in range(enc.n_vocab)]
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 256):
                batch = whole.slice(at, 256)
                cols: dict[str, list] = {c: [] for c in added}
                for text in batch.column(text_col).to_pylist():
                    ids = encode(text, encodings, piece)
                    cols["n_tokens"].append(len(ids))
                    if keep_ids:
                        cols["ids"].append(ids)
                    if digests:
                        cols["ids_sha256"].append(hashlib.sha256(" ".join([words[i] for i in ids]).encode()).hexdigest())
                        cols["decoded_sha256"].append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                arrow = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cols[c], arrow[c]) for c in added]], [*batch.schema.names, *added])

    return kept.mapInArrow(run, out)


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded`, the raw bytes of each row's ids (null ids give null): bytes, as ids may end within a character."""
    out = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in encoded.drop("decoded").schema] + ["decoded binary"])

    shipped = _shipped(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encodings(shipped.value, pattern)[0]
        for batch in batches:
            raw = [None if ids is None else enc.decode_bytes(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.drop("decoded").mapInArrow(run, out)
