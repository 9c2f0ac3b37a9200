"""Near-duplicates by HyperMinHash.

A document's set of word shingles is hashed once. Its sketch has REGISTERS buckets; the register of a bucket holds how
many leading zeros the smallest hash in it has, and the MANTISSA bits that follow (Yu and Weber, 2017). Bands of ROWS
registers are the keys that candidates share; sets of up to SHORT shingles, whose registers are mostly empty, have exact
keys besides. Candidates are measured by their registers, with the expected chance agreements taken off, and those within
reach of the threshold are verified on their full sets.

Two things lose a link whose Jaccard index is just at the threshold, both by chance: no band in common (README gives
measured rates), and an estimate more than MARGIN standard errors too low (under 1e-6). Nothing else does: every bucket's
nodes end in one component or were measured against each other.

Texts with one set are one node from the start. Verification asks only what components still need. First every node meets
the smallest nodes of its buckets, and the best candidate among them is verified. What is left are buckets that hold
several components. In one of at most SMALL nodes, those of different components are measured against each other and what
may link is verified. The nodes of larger ones meet by rare shingles: two sets of an index of 0.75 share one of the first quarter and one
of either set in any fixed order of all shingles, so with frequent shingles ordered last, texts that merely share a passage
don't meet, and all that can link do. Where they meet, each node tries the best of some drawn from those it meets; at last
sketches say which node may still link with which component, and full sets, computed from the texts in question, answer in
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import kernels
from riskloom.llm.components import components
from riskloom.llm.shared import Scratch, blocks, named, slices, whole_row

REGISTERS, ROWS, MANTISSA = 160, 4, 10
EMPTY = 0xFFFF
#: Weight of a block at most, when sets or sketches meet: a set weighs 1, and 1 more for each HEAVY shingles.
BLOCK, HEAVY = 256, 4096
#: Bytes of full sets in an Arrow batch, about, and places in a row that says where a node's set goes.
BATCH, PLACES = 1 << 23, 1024
#: Ids of 8 bytes that may be broadcast to pick the texts in question, 2 MB of them; beyond that all texts are dealt by id.
FEW = 1 << 18
#: Standard errors below the threshold at which an estimate rules a pair out.
MARGIN = 5.0
#: Shingles up to which a set has its own first shingles as keys, too.
SHORT = 8
#: Nodes of a bucket that are measured pair by pair; larger buckets go by rare shingles.
SMALL = 64
#: Bits of a hash that name a slot of the map of frequent shingles, a fixed 4 MB that at most a quarter as many enter.
SLOT_BITS = 22
U = np.uint64


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each sorted set of 64-bit hashes, as little-endian 16-bit numbers."""
    out = np.full((len(sets), REGISTERS), EMPTY, np.uint16)
    h = np.concatenate(sets) if sets else np.zeros(0, U)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    scaled = (h >> U(32)) * U(REGISTERS)
    bucket, rest = (scaled >> U(32)).astype(np.int64), (scaled << U(32)) | (h & U(0xFFFFFFFF))
    # Sets are sorted, so the first of a bucket is its smallest.
    first = np.flatnonzero(np.diff(doc * REGISTERS + bucket, prepend=-1))
    rest = np.maximum(rest[first], U(1))
    zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros = np.clip(np.where(zeros < 0, 0, zeros), 0, 62)
    # log2 may round up at a power of two.
    zeros += ((rest << zeros.astype(U)) >> U(63) == 0).astype(np.int64)
    tail = ((rest << zeros.astype(U)) << U(1)) >> U(64 - MANTISSA)
    out[doc[first], bucket[first]] = (zeros.astype(np.uint16) << MANTISSA) | tail.astype(np.uint16)
    return out


def jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Estimates for rows of registers: agreement among buckets that either fills, without the agreements by chance.

    Two filled registers of unlike elements agree with a probability of about 0.17 * 2**-MANTISSA * 4 r / (1 + r)**2,
    r being the ratio of the sizes.
    """
    filled = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(filled.sum(axis=-1), 1)
    same = ((a == b) & filled).sum(axis=-1)
    r = na / np.maximum(nb, 1)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * r / (1 + r) ** 2 * n
    return np.clip((same - chance) / np.maximum(n - chance, 1e-9), 0, 1)


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs may have the threshold: by size, which is exact, and by an estimate within MARGIN errors."""
    n = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(axis=-1), 1)
    error = np.sqrt(threshold * (1 - threshold) / n)
    return (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9) & (jaccard(a, b, na, nb) >= threshold - MARGIN * error)


def prefix_size(n: int, threshold: float = 0.75) -> int:
    """How many of a set's shingles, the first in any one order of all, hold one of every set that has the threshold with it."""
    return n - -(-round(100 * threshold) * n // 100) + 1


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """id, n (shingles), a, b (digest of the set), regs and short (exact keys of a short set) for each row; regs is null
    for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, ids = kernels.as_bytes(batch.column(1)), batch.column(0)
            for lo, hi in blocks([len(t) for t in texts], kernels.BLOCK):
                sets = kernels.shingle_sets(texts[lo:hi], k)
                digest = zip(*map(_digest, sets))
                regs = [r.tobytes() if len(s) else None for r, s in zip(sketch(sets), sets)]
                short = [s[: prefix_size(len(s), threshold)].view(np.int64) if 0 < len(s) <= SHORT else [] for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(d, pa.int64()) for d in digest], pa.array(regs, pa.binary()), pa.array(short, pa.list_(pa.int64()))], ["id", "n", "a", "b", "regs", "short"])

    src = docs.select(named(id_col)[0].cast("long").alias("id"), named(text_col)[0].alias("t"))
    return src.mapInArrow(run, "id bigint, n bigint, a bigint, b bigint, regs binary, short array<bigint>")


def band_keys() -> Column:
    """The key of each band of regs and of each short key, as array<bigint>; bands with no filled register have none."""
    width = 2 * ROWS
    key = lambda i: F.when(F.substring(F.col("regs"), i * width + 1, F.lit(width)) != F.lit(b"\xff" * width), F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width))))
    return F.concat(F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), key)), F.transform("short", lambda x: F.xxhash64(F.lit(-1), x)))


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return tuple(int((kernels.mix(s + U(c)).sum(dtype=U) ^ U(len(s))).view(np.int64)) for c in (1, 2))


def reaches(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two full sets have the threshold, in whole hundredths."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= round(100 * threshold) * (len(a) + len(b) - both)


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """u, v -> u, v, est for the pairs that may reach the threshold."""
    left = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("regs").alias("ru"))
    right = nodes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("regs").alias("rv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _regs(batch.column("ru")), _regs(batch.column("rv"))
                na, nb = batch.column("nu").to_numpy(), batch.column("nv").to_numpy()
                keep = pa.array(may_reach(a, b, na, nb, threshold))
                out = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(jaccard(a, b, na, nb))], ["u", "v", "est"])
                yield out.filter(keep)

    return pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", "ru", "rv").mapInArrow(run, "u bigint, v bigint, est double")


def weight(n: Column) -> Column:
    return F.floor(n / HEAVY) + 1


def _picked(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """wanted (id and others) with t, the texts of its ids. Texts in question are picked where they are read, if their ids are
    few; what is left meets by id."""
    d = docs.select(named(id_col)[0].cast("long").alias("id"), named(text_col)[0].alias("t"))
    ids = wanted.select("id").distinct()
    if ids.count() <= FEW:
        d = d.join(F.broadcast(ids), "id", "left_semi")
    return d.join(wanted, "id")


def _texts(docs: DataFrame, asked: DataFrame, nodes: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """node, at (a place: a struct) -> node, a, b, at (array of at most about PLACES), t: the texts whose sets go there."""
    asked = scratch.cut(asked, "asked")
    lanes = asked.groupBy("node").agg(F.ceil(F.count("*") / PLACES).alias("lanes"))
    wanted = asked.join(lanes, "node").groupBy("node", F.pmod(F.xxhash64("at"), F.col("lanes")).alias("lane")).agg(F.collect_list("at").alias("at"))
    wanted = scratch.cut(wanted.join(nodes.select("node", "id", "a", "b"), "node").drop("lane"), "wanted")
    return _picked(docs, wanted, id_col, text_col).select("node", "a", "b", "at", "t")


def _sets(schema: pa.Schema, k: int):
    """A function for mapInArrow over rows of _texts: a row of schema (fields of the place, node, raw) for each place."""
    fields = schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                node, a, b, at = (batch.column(i).to_pylist() for i in range(4))
                texts = kernels.as_bytes(batch.column(4))
                for lo, hi in blocks([len(t) for t in texts], kernels.BLOCK):
                    for i, s in zip(range(lo, hi), kernels.shingle_sets(texts[lo:hi], k)):
                        # Rows that share an id may hold other texts.
                        if _digest(s) == (a[i], b[i]):
                            raw = s.tobytes()
                            for p in at[i]:
                                rows.append((*(p[c] for c in fields), node[i], raw))
                                size += len(raw) + 64
                                if size > BATCH:
                                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs u, v whose full sets have the threshold.

    Pairs meet in blocks of one v and u of a weight of about BLOCK; each set goes to the blocks that ask for it.
    """
    pairs = scratch.cut(pairs.select("u", "v"), "pairs")
    size = pairs.join(nodes.select(F.col("node").alias("u"), weight(F.col("n")).alias("w")), "u").groupBy("v").agg(F.ceil(F.sum("w") / BLOCK).cast("int").alias("parts"))
    placed = pairs.join(size, "v").select(F.col("u").alias("node"), F.struct("v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part")).alias("at"))
    centres = size.select(F.col("v").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "v").select("node", F.struct("v", "part").alias("at"))

    def meet(table: pa.Table) -> pa.Table:
        v = table.column("v")[0].as_py()
        own = dict(zip(table.column("node").to_pylist(), table.column("raw").to_pylist()))
        centre = np.frombuffer(own[v], U) if v in own else np.zeros(0, U)
        found = []
        for u, raw in own.items():
            s = np.frombuffer(raw, U)
            if u != v and len(s) and len(centre) and reaches(s, centre, threshold):
                found.append(u)
        return pa.table({"u": pa.array(found, pa.int64()), "v": pa.array([v] * len(found), pa.int64())})

    src = _texts(docs, placed.unionByName(centres), nodes, id_col, text_col, scratch)
    schema = pa.schema([("v", pa.int64()), ("part", pa.int32()), ("node", pa.int64()), ("raw", pa.binary())])
    return scratch.cut(src.mapInArrow(_sets(schema, k), "v bigint, part int, node bigint, raw binary").groupBy("v", "part").applyInArrow(meet, "u bigint, v bigint"), "verified")


def _small(keyed: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """u, v: of small buckets (key, node, root) that hold several components, the pairs of nodes in different ones that may
    reach the threshold. A bucket has at most SMALL nodes, so the pairs measured are at most SMALL for each row."""
    packs = max(1, keyed.count() // (16 * BLOCK))
    rows = keyed.join(nodes.select("node", "n", "regs"), "node").withColumn("pack", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(packs)))

    def meet(table: pa.Table) -> pa.Table:
        key, node, root, n = (table.column(c).to_numpy() for c in ("key", "node", "root", "n"))
        regs = _regs(table.column("regs"))
        order = np.lexsort((node, key))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            x, y = np.triu_indices(len(at), 1)
            x, y = at[x], at[y]
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
            near = may_reach(regs[x], regs[y], n[x], n[y], threshold)
            us.append(node[x[near]])
            vs.append(node[y[near]])
        return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return rows.groupBy("pack").applyInArrow(meet, "u bigint, v bigint").distinct()


def _mixed(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node and others -> the same with root, for the keys at which different components meet."""
    r = roots.select(F.col("node").alias("_k"), F.col("root").alias("_r"))
    m = keyed.join(r, F.col("node") == F.col("_k"), "left").withColumn("root", F.coalesce("_r", "node")).drop("_k", "_r")
    return m.join(m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "key", "left_semi")


def _rare(shared: DataFrame, nodes: DataFrame, roots: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, scratch: Scratch) -> DataFrame:
    """key, node, n, pos, root: the nodes of buckets (key, node) that hold several components, by the rare shingles where
    different components meet. pos is the place of the shingle in the set of n.

    Shingles stand in the order of the logarithm of their count over all these nodes, then of their hash. Counts come from
    a map by slot, which at most 2**(SLOT_BITS - 2) shingles enter, those counted most; so it never fills up, and the order
    is one for all sets, whatever the slots say. Where the first shingle that two sets share stands at pos, they share no
    more than what follows in either; rows with no partner that this would let link go.
    """
    open_ = scratch.cut(_mixed(shared, roots).select("node").distinct(), "open")
    at = scratch.cut(open_.join(nodes.select("node", "id", "a", "b", "n"), "node"), "open-nodes")
    src = _picked(docs, at.drop("n"), id_col, text_col).select("node", "a", "b", "t")
    often = max(2, (at.agg(F.sum("n")).first()[0] or 0) >> (SLOT_BITS - 2))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            node, a, b = (batch.column(i).to_pylist() for i in range(3))
            texts = kernels.as_bytes(batch.column(3))
            for lo, hi in blocks([len(t) for t in texts], kernels.BLOCK):
                own = [(node[i], s.tobytes()) for i, s in zip(range(lo, hi), kernels.shingle_sets(texts[lo:hi], k)) if _digest(s) == (a[i], b[i])]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], ["node", "raw"])

    sets = scratch.cut(src.mapInArrow(hashed, "node bigint, raw binary"), "open-sets")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for node, raw in zip(batch.column(0), batch.column(1)):
                yield node.as_py(), np.frombuffer(raw.as_buffer(), U)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in each(batches):
            for i in range(0, len(s), BATCH >> 3):
                yield pa.RecordBatch.from_arrays([pa.array(s[i : i + (BATCH >> 3)].view(np.int64))], ["key"])

    counts = sets.mapInArrow(counted, "key bigint").groupBy("key").count().where(F.col("count") >= often)
    slots = counts.groupBy(F.shiftrightunsigned("key", 64 - SLOT_BITS).cast("int").alias("slot")).agg(F.floor(F.log2(F.max("count"))).cast("tinyint").alias("level")).toArrow()
    levels = np.zeros(1 << SLOT_BITS, np.int8)
    levels[slots.column("slot").to_numpy()] = slots.column("level").to_numpy()
    shared_levels = docs.sparkSession.sparkContext.broadcast(levels)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, s in each(batches):
            level = shared_levels.value[(s >> U(64 - SLOT_BITS)).astype(np.int64)]
            keys = s[np.argsort(level, kind="stable")[: prefix_size(len(s), threshold)]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), node)), pa.array(np.full(len(keys), len(s))), pa.array(np.arange(len(keys)))], ["key", "node", "n", "pos"])

    keyed = sets.mapInArrow(first, "key bigint, node bigint, n bigint, pos bigint")
    least = keyed.groupBy("key").agg(F.min("n").alias("_least"), F.count("*").alias("_c")).where("_c > 1")
    hope = F.col("n") - F.col("pos") >= overlap(F.col("n"), F.greatest(F.col("_least"), F.ceil(F.col("n") * threshold - 1e-9)), threshold)
    # Rows that repeat an id and a text give their set twice.
    return scratch.cut(_mixed(keyed.join(least, "key").where(hope).drop("_least", "_c").distinct(), roots), "rare")


def overlap(n: Column, m: Column, threshold: float) -> Column:
    """The least number of common shingles with which sets of n and m have the threshold."""
    t = round(100 * threshold)
    return F.ceil((n + m) * t / (100 + t) - 1e-9)


def _tries(keyed: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """u, v: each node with the best by estimate of those that a draw made the centres of its keys, in other components."""
    drawn = keyed.groupBy("key").agg(F.min_by(F.struct("node", "root", "n", "pos"), F.xxhash64("key", "node")).alias("c"))
    hope = F.least(F.col("n") - F.col("pos"), F.col("c.n") - F.col("c.pos")) >= overlap(F.col("n"), F.col("c.n"), threshold)
    pairs = keyed.join(drawn, "key").where("root <> c.root").where(hope).select(F.col("node").alias("u"), F.col("c.node").alias("v")).distinct()
    return _estimated(pairs, nodes, threshold).groupBy("u").agg(F.max_by("v", F.struct("est", F.negate("v"))).alias("v"))


def _asks(keyed: DataFrame, nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """u, r: nodes and the other components that they may reach the threshold with, among the nodes they share a key with.

    keyed has key, node, n, pos and root. The members of a key's largest component are at home; those outside it meet all others: in
    tiles of two chunks of at most about BLOCK sketches, those at home going once to each chunk of the rest. What leaves a
    tile is a row for each node of the rest and component that it may link with, so the members of a large component
    don't multiply. Keys of one tile share tasks' groups.
    """
    packs = max(1, keyed.count() // (4 * BLOCK))
    sizes = roots.groupBy("root").agg(F.count("*").alias("_c"))
    m = keyed.join(sizes, "root", "left").withColumn("_c", F.coalesce("_c", F.lit(1)))
    home = m.groupBy("key").agg(F.max_by("root", F.struct("_c", "root")).alias("home"))
    m = m.drop("_c").join(home, "key").withColumn("out", F.col("root") != F.col("home"))
    split = m.groupBy("key").agg(F.count_if(F.col("out")).alias("n_out"), F.count_if(~F.col("out")).alias("n_home"))
    split = split.select("key", F.ceil(F.col("n_out") / BLOCK).cast("int").alias("c_out"), F.ceil(F.col("n_home") / BLOCK).cast("int").alias("c_home"))
    m = m.join(split, "key")
    chunk = F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("c_out")).otherwise(F.col("c_home"))).cast("int")
    m = m.withColumn("chunk", chunk)
    # A tile is (chunk of the rest, other chunk): the other is one of the rest that isn't before it, or -1 - chunk at home.
    rest = F.concat(F.transform(F.sequence(F.lit(0), F.col("c_out") - 1), lambda j: F.struct(F.least(F.col("chunk"), j).alias("i"), F.greatest(F.col("chunk"), j).alias("j"))), F.when(F.col("c_home") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("c_home") - 1, F.lit(0))), lambda j: F.struct(F.col("chunk").alias("i"), (-1 - j).alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>")))
    at_home = F.transform(F.sequence(F.lit(0), F.col("c_out") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("chunk")).alias("j")))
    # Rows are dealt by node when tiles are named, so a large bucket's are spread.
    m = m.join(nodes.select("node", "regs"), "node")
    pack = F.when((F.col("c_out") == 1) & (F.col("c_home") == 1), F.pmod(F.xxhash64("key", F.lit(2)), F.lit(packs))).otherwise(F.col("key"))
    tiles = m.select("*", F.explode(F.when(F.col("out"), rest).otherwise(at_home)).alias("tile")).select(pack.alias("pack"), "key", "tile.i", "tile.j", "node", "root", "chunk", "out", "n", "pos", "regs")
    t = round(100 * threshold)

    def meet(table: pa.Table) -> pa.Table:
        key, i, j, node, root, n, pos, chunk = (table.column(c).to_numpy() for c in ("key", "i", "j", "node", "root", "n", "pos", "chunk"))
        out, regs = np.array(table.column("out").to_pylist(), bool), _regs(table.column("regs"))
        order = np.lexsort((j, i, key))
        new = np.flatnonzero(np.diff(key[order], prepend=0, append=0).astype(bool) | np.diff(i[order], prepend=-1, append=-1).astype(bool) | np.diff(j[order], prepend=-(2**31), append=-(2**31)).astype(bool))
        us, rs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in np.split(order, new)[1:-1]:
            first = at[out[at] & (chunk[at] == i[at[0]])]
            second = first if i[at[0]] == j[at[0]] else at[out[at] & (chunk[at] == j[at[0]])] if j[at[0]] >= 0 else at[~out[at]]
            for x in first:
                rest = second if i[at[0]] != j[at[0]] else second[node[second] < node[x]]
                # By the places of the key first: this is exact, and spares most of the rest.
                most = np.minimum(n[x] - pos[x], n[rest] - pos[rest])
                rest = rest[(root[rest] != root[x]) & ((100 + t) * most >= t * (n[x] + n[rest]))]
                if len(rest):
                    keep = np.unique(root[rest[may_reach(regs[x][None, :], regs[rest], n[x], n[rest], threshold)]])
                    us.append(np.full(len(keep), node[x]))
                    rs.append(keep)
        return pa.table({"u": np.concatenate(us), "r": np.concatenate(rs)})

    return tiles.groupBy("pack", "i", "j").applyInArrow(meet, "u bigint, r bigint").distinct()


def _answered(asks: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, scratch: Scratch) -> DataFrame:
    """u, v: for each node and component asked for (u, r), a member v whose full set has the threshold with u's, if any.

    Members of a large component are split into parts of a weight of about BLOCK, small components share blocks of that
    weight. A member's set goes to one block, a node's to the blocks that hold a component it asks for; nodes are dealt in chunks.
    """
    asks = scratch.cut(asks, "asks")
    wanted_r = scratch.cut(asks.select("r").distinct(), "asked-components")
    own = roots.select(F.col("node").alias("member"), F.col("root").alias("r")).join(wanted_r, "r", "left_semi")
    alone = wanted_r.join(roots.select(F.col("root").alias("r")).distinct(), "r", "left_anti").select(F.col("r").alias("member"), "r")
    weights = nodes.select(F.col("node").alias("member"), weight(F.col("n")).alias("w"))
    members = scratch.cut(own.unionByName(alone).join(weights, "member"), "members")
    sizes = members.groupBy("r").agg(F.sum("w").alias("c"))
    groups = max(1, -(-(sizes.where(F.col("c") <= BLOCK).agg(F.sum("c")).first()[0] or 0) // BLOCK))
    sizes = sizes.select("r", F.when(F.col("c") <= BLOCK, F.pmod(F.xxhash64("r"), F.lit(groups))).otherwise(-1 - F.col("r")).alias("block"), F.when(F.col("c") <= BLOCK, 1).otherwise(F.ceil(F.col("c") / BLOCK)).cast("int").alias("parts"))
    asked = asks.join(sizes, "r").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.groupBy("u", "block", "part").agg(F.collect_set("r").alias("rs")).join(weights.withColumnRenamed("member", "u"), "u")
    # As many chunks for a block as keep nodes of a weight of about 4 * BLOCK together.
    chunks = scratch.cut(asked.groupBy("block", "part").agg(F.ceil(F.sum("w") / (4 * BLOCK)).cast("int").alias("chunks")), "chunks")
    placed = asked.join(chunks, ["block", "part"]).select(F.col("u").alias("node"), F.struct("block", "part", F.pmod(F.xxhash64("u", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), F.lit(None).cast("long").alias("r"), "rs").alias("at"))
    homes = members.join(sizes, "r").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")).join(chunks, ["block", "part"])
    homes = homes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(F.col("member").alias("node"), F.struct("block", "part", "chunk", "r", F.lit(None).cast("array<bigint>").alias("rs")).alias("at"))
    src = _texts(docs, placed.unionByName(homes), nodes, id_col, text_col, scratch)

    def meet(table: pa.Table) -> pa.Table:
        node, raw, home, rs = (table.column(c).to_pylist() for c in ("node", "raw", "r", "rs"))
        own = [np.frombuffer(x, U) for x in raw]
        regs, n = sketch(own), np.array([len(x) for x in own])
        ys = np.array([i for i, r in enumerate(home) if r is not None], np.int64)
        r = np.array([home[i] for i in ys], np.int64)
        us, vs = [], []
        for x in (i for i, asked_for in enumerate(rs) if asked_for is not None):
            near = np.flatnonzero(np.isin(r, rs[x]) & (may_reach(regs[x][None, :], regs[ys], n[x], n[ys], threshold) if len(ys) else False))
            done = set()
            for y in near[np.argsort(-jaccard(regs[x][None, :], regs[ys[near]], n[x], n[ys[near]]), kind="stable")]:
                if r[y] not in done and reaches(own[x], own[ys[y]], threshold):
                    done.add(r[y])
                    us.append(node[x])
                    vs.append(node[ys[y]])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    fields = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), ("r", pa.int64()), ("rs", pa.list_(pa.int64())), ("node", pa.int64()), ("raw", pa.binary())])
    schema = "block bigint, part int, chunk int, r bigint, rs array<bigint>, node bigint, raw binary"
    return scratch.cut(src.mapInArrow(_sets(fields, k), schema).groupBy("block", "part", "chunk").applyInArrow(meet, "u bigint, v bigint"), "answered")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of all documents that links reach) and kept for every row.

    Words are lower-cased (A-Z) and shingles are k words, distinct; a text with fewer words is one shingle, and one with
    none (or null) links with nothing. Two rows link if the Jaccard index of their sets is at least threshold (in
    hundredths). kept is doc_id = component_id: rows that repeat an id are kept or go together. A row without an id is
    counted but links with nothing: its component_id is null and it is kept. Other columns are left behind.
    """
    scratch, result = Scratch(docs.sparkSession, "near"), Scratch(docs.sparkSession, "near-duplicates")
    where = (id_col, text_col, k, threshold, scratch)
    rows = scratch.cut(sketches(docs, id_col, text_col, k, threshold), "sketches")
    linked = rows.where("n > 0 and id is not null")
    nodes = linked.groupBy("a", "b").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.first("regs").alias("regs"), F.first("short").alias("short"))
    nodes = scratch.cut(nodes.select(F.monotonically_increasing_id().alias("node"), "a", "b", "id", "n", "regs", "short"), "nodes")
    keys = nodes.select("node", F.explode(F.array_distinct(band_keys())).alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1")
    shared = scratch.cut(keys.join(buckets.select(F.col("key").alias("_b"), "centre", "members"), F.col("key") == F.col("_b")).select("key", "node", "centre", "members"), "buckets")
    near = _estimated(shared.where("node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct(), nodes, threshold)
    near = scratch.cut(near, "near")

    def joined(links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
        """The components of new links and of those that are known."""
        known = links if roots is None else links.unionByName(roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
        return components(known, keep=scratch)

    best = near.groupBy("u").agg(F.max_by("v", F.struct("est", F.negate("v"))).alias("v"))
    roots = joined(_verified(best, nodes, docs, *where))
    small = scratch.cut(_mixed(shared.where(F.col("members") <= SMALL).select("key", "node"), roots), "small")
    pairs = _small(small, nodes, threshold)
    keyed = _rare(shared.where(F.col("members") > SMALL).select("key", "node"), nodes, roots, docs, *where)
    roots = joined(_verified(_tries(keyed, nodes, threshold).unionByName(pairs).distinct(), nodes, docs, *where), roots)
    keyed = scratch.cut(_mixed(keyed.drop("root"), roots), "rare")
    roots = joined(_answered(_asks(keyed, nodes, roots, threshold), roots, nodes, docs, *where), roots)
    tops = nodes.join(roots, "node", "left").select("a", "b", "id", F.coalesce("root", "node").alias("root"))
    least = tops.groupBy("root").agg(F.min("id").alias("component_id")).withColumnRenamed("root", "_root")
    known = tops.join(least, F.col("root") == F.col("_root")).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "component_id")
    out = linked.join(known, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("id", "n", "component_id")
    alone = rows.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    out = out.unionByName(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    out = result.cut(out, "result")
    scratch.drop()
    return out


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates keeps. Of rows that repeat an id and a text the one
    whose columns come first as JSON stays."""
    kept = near_duplicates(docs, id_col, text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    d = docs.select(whole_row(docs), named(id_col)[0].alias("_id"), F.xxhash64(named(text_col)[0]).alias("_text"))
    one = Window.partitionBy("_id", "_text").orderBy(F.to_json("_row", {"ignoreNullFields": "false"}))
    found = d.where("_id is not null").join(kept, F.col("_id") == F.col("_kept"), "left_semi").withColumn("_nth", F.row_number().over(one)).where("_nth = 1")
    return found.unionByName(d.where("_id is null").withColumn("_nth", F.lit(1))).select("_row.*")
