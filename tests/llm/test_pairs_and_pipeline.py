"""Near-duplicates, components, nearest neighbours and the pipeline against brute force, with edge cases."""

import importlib.util
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann, dedup, kernels
from riskloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def near_texts(n=160, seed=5):
    """Families of near copies at edit rates on both sides of the threshold, in shuffled order, with chains."""
    r = random.Random(seed)
    out = []
    for family in range(n // 20):
        text = [f"f{family}w{r.randrange(500)}" for _ in range(r.choice([6, 12, 40, 200]))]
        for _ in range(18):
            out.append(" ".join(text))
            if r.random() < 0.7:
                text = list(text)
                for _ in range(max(1, len(text) // r.choice([15, 30, 60]))):
                    text[r.randrange(len(text))] = f"e{r.randrange(10**6)}"
        out += [out[-1].upper(), out[-1].replace(" ", "\n ")]
    r.shuffle(out)
    return [*out, None, "", " \t", "one", "ONE", "one two", "a b c d", "A b\tc d", "É x y z w", "é x y z w", "v " * 20_000]


def test_near_duplicates_match_brute_force(spark, n=160):
    texts = near_texts(n)
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    sets = {i: shingles(t) for i, t in enumerate(texts)}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return bool(sets[a]) and bool(sets[b]) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)

    want = brute_components(list(sets), linked)
    got = dedup.near_duplicates(df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    assert {r.doc_id for r in dedup.kept_rows(df).collect()} == {i for i in want if want[i] == i}


def test_rows_without_ids_repeated_rows_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, None), (9, "q r s t u v"), (9, "other words under this same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(True, 0, 2, None, True), (False, 3, 2, 1, False), (False, 3, 2, 1, False), (False, 1, 2, 1, True), (True, 0, 0, None, True), (False, 9, 2, 9, True), (False, 9, 2, 9, True)], key=str)
    assert dedup.near_duplicates(df.limit(0)).count() == 0


def test_small_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 3)
    monkeypatch.setattr(dedup, "HEAVY", 64)
    monkeypatch.setattr(dedup, "BATCH", 2_000)
    monkeypatch.setattr(dedup, "PLACES", 2)
    monkeypatch.setattr(dedup, "SMALL", 2)
    test_near_duplicates_match_brute_force(spark, 40)


def crowd(n, edits, seed):
    """n texts of 60 words that differ from one in so many places each, most of them short of the threshold with each other."""
    r = random.Random(seed)
    base = [f"b{r.randrange(10**6)}" for _ in range(60)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in r.sample(range(60), r.choice(edits)):
            text[at] = f"e{r.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def crowd_components(texts):
    """By counts of common shingles for all pairs at once."""
    sets = [shingles(t) for t in texts]
    names = {x: i for i, x in enumerate(dict.fromkeys(x for s in sets for x in s))}
    has = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        has[i, [names[x] for x in s]] = 1
    both, n = has @ has.T, has.sum(axis=1)
    near = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    root = np.arange(len(sets))
    while True:
        least = np.where(near, root[None, :], len(sets)).min(axis=1)
        if (least == root).all():
            return root
        root = np.minimum(root, least)


def test_a_large_group_below_the_threshold_of_each_other(spark):
    texts = crowd(900, (2, 2, 3, 4), 4)
    shared = " ".join(f"s{i}" for i in range(40))
    r = random.Random(6)
    passage = [f"{shared} " + " ".join(f"o{r.randrange(10**6)}" for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts + passage)), "doc_id long, text string")
    want = [*crowd_components(texts).tolist(), *range(900, 1_200)]
    assert 50 < len(set(want[:900])) < 900
    assert [x.component_id for x in dedup.near_duplicates(df).orderBy("doc_id").collect()] == want


def test_short_sets_at_the_threshold_always_meet(spark):
    # Words of sets of 3 of 4 and 4 of 5 shingles: an index of 0.75 and 0.8.
    texts = [x for f in range(1_000) for x in (f"{f}a {f}b {f}c {f}d {f}e {f}f {f}g", f"{f}a {f}b {f}c {f}d {f}e {f}f {f}g {f}h")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dedup.near_duplicates(df).where("component_id <> doc_id - doc_id % 2").count() == 0


def chains_of_twos(size, wanted, seed):
    """Texts a, w, b with a-w and w-b at an index of exactly 0.75, where each pair shares bands but no band is common to all.

    w has `size` shingles; a and b each have a seventh of theirs in place of a seventh of its. Sets that leave registers
    empty (112 shingles and fewer) have no such chain in tens of thousands; of 560 shingles, one in a hundred is one.
    """
    r, found = random.Random(seed), []
    fresh = lambda n: [f"x{r.randrange(10**9)}" for _ in range(n)]
    swap = size // 7
    while len(found) < wanted:
        made = []
        for _ in range(64):
            w = fresh(size + 4)
            a, b = fresh(swap) + w[swap:], w[:-swap] + fresh(swap)
            made.append([" ".join(x) for x in (a, w, b)])
        regs = dedup.sketch(kernels.shingle_sets([t.encode() for x in made for t in x])).reshape(-1, 3, dedup.REGISTERS // dedup.ROWS, dedup.ROWS)
        same = lambda i, j: (regs[:, i] == regs[:, j]).all(axis=2) & (regs[:, i] != dedup.EMPTY).any(axis=2)
        aw, wb = same(0, 1), same(1, 2)
        found += [made[i] for i in np.flatnonzero(aw.any(axis=1) & wb.any(axis=1) & ~(aw & wb).any(axis=1))]
    return found[:wanted]


def test_chains_whose_links_share_buckets_of_two_only(spark):
    chains = chains_of_twos(560, 150, 3)
    both = [len(shingles(a) & shingles(w)) * 100 == 75 * len(shingles(a) | shingles(w)) for a, w, _ in chains]
    assert all(both)
    for order in ((0, 1, 2), (1, 0, 2)):
        rows = [(3 * i + order[j], t) for i, c in enumerate(chains) for j, t in enumerate(c)]
        random.Random(order[0]).shuffle(rows)
        got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert got.where("component_id <> doc_id - doc_id % 3").count() == 0


def test_a_very_long_copy_and_odd_column_names(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    df = spark.createDataFrame([(1, long, "x", 1, 2), (2, long + " tail", "y", 1, 2), (2, long + " tail", "x", 1, 2), (3, None, "z", 1, 2)], "doc_id long, text string, `a.b` string, _nth long, _kept long")
    assert sorted((r.doc_id, r.component_id) for r in dedup.near_duplicates(df).collect()) == [(1, 1), (2, 1), (2, 1), (3, 3)]
    assert sorted((r["doc_id"], r["a.b"]) for r in dedup.kept_rows(df.union(df.where("doc_id = 1"))).collect()) == [(1, "x"), (3, "z")]


def test_estimates_are_near_the_index():
    r = np.random.default_rng(0)
    pool = r.integers(0, 2**63, 4000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.75, 0.95):
        n = 2000
        both = int(2 * n * share / (1 + share))
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
        s = dedup.sketch([np.sort(kernels.mix(a)), np.sort(kernels.mix(b))])
        assert abs(dedup.jaccard(s[0], s[1], np.array(n), np.array(n)) - share) < 0.15


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_nearest(rows, queries, top):
    use = [(i, np.array(v, float)) for i, v in rows]
    for q, x in [u for u in use if u[0] in queries]:
        scored = sorted(((-float(np.dot(x, v)), i) for i, v in use if i != q))
        yield q, [(i, -s) for s, i in scored[:top]]


def test_neighbours_with_ties_copies_and_odd_vectors(spark):
    r = np.random.default_rng(2)
    good = [(i, r.normal(size=8).round(2).tolist()) for i in range(200)]
    good += [(i, good[0][1]) for i in range(200, 260)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [float("inf")] + [1.0] * 7), (1080, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in good + odd] + [(1100, [None] + [1.0] * 7, "x", 0)], "vec_id long, embedding array<double>, score string, rank int")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), reach=0.999).collect()
    want = dict(brute_nearest(good, {i for i, _ in good if i % 20 == 0}, 20))
    hit = 0
    for q, near in want.items():
        own = sorted((x.rank, x.vec_id, x.score) for x in got if x.query_id == q)
        assert [k for k, _, _ in own] == list(range(1, 21))
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        hit += len({i for _, i, _ in own} & {i for i, _ in near})
    assert {x.query_id for x in got} == set(want) and hit >= 0.9 * 20 * len(want)
    few = spark.createDataFrame(good[:5], "vec_id long, embedding array<double>")
    assert sorted((x.rank, x.vec_id) for x in ann.nearest(few, few.where("vec_id = 0")).collect()) == [(k + 1, i) for k, (i, _) in enumerate(next(iter(dict(brute_nearest(good[:5], {0}, 20)).values())))]
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0 and ann.nearest(few.limit(1), few.limit(1)).count() == 0


def test_each_length_is_a_search_of_its_own(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8 if i % 3 else 5).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # The commonest length among the queries isn't that of the table.
    asked = [i for i in range(90) if i % 9 == 0 or i == 40]
    got = ann.nearest(df, df.where(F.col("vec_id").isin(asked)), top=5, reach=0.999).collect()
    for q in asked:
        own = [x for x in rows if len(x[1]) == len(rows[q][1])]
        want = dict(brute_nearest(own, {q}, 5))[q]
        found = [x.vec_id for x in sorted(got, key=lambda x: x.rank) if x.query_id == q]
        assert len(found) == 5 and len(set(found) & {i for i, _ in want}) >= 4


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall_at_the_parameters_of_the_query(spark, spread):
    """Clustered and random vectors of 48 dimensions against brute force."""
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 48))[r.integers(0, 40, 4_000)] * (spread < 1) + spread * r.normal(size=(4_000, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    score = x[::20] @ x.T
    score[np.arange(200), np.arange(0, 4_000, 20)] = -np.inf
    want = np.argsort(-score, axis=1, kind="stable")[:, :20]
    hits = sum(g.vec_id in set(want[g.query_id // 20]) for g in got)
    assert len(got) == 4_000 and hits >= 0.9 * 4_000


def test_probes_come_in_the_order_of_their_chances():
    got = list(ann.probes(np.array([0.2, 3.7, -1.5]), 0.6, 0.9))
    chances = [p for _, p in got]
    assert chances == sorted(chances, reverse=True) and 0.9 <= sum(chances) < 1 and len({c for c, _ in got}) == len(got)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_stages_do_their_work(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(1)
    good = [" ".join(f"g{r.randrange(2000)}" for _ in range(40)) for _ in range(60)]
    texts = [*good, good[0] + " tail", "too short", None, "", good[1] + " mail me@x.org now", " ".join(["again and again it goes on"] * 9)]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), "t")
        seen[name] = {x.doc_id: x for x in docs.collect()}
        if name != "token ids":
            assert docs.columns == df.columns
    assert set(seen["quality rules"]) == set(range(60)) | {60, 64}
    assert set(seen["near-duplicates"]) == set(range(60))
    assert all(x.text == good[i] for i, x in seen["personal data"].items())
    assert set(seen["source mix"]) <= set(range(60)) and len(seen["source mix"]) > 20
    assert all(len(x.ids) == x.n_tokens > 0 for x in seen["token ids"].values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_components_are_finished_or_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {(r.node, r.root) for r in components(path).collect()} == {(i, 0) for i in range(61)}
    with pytest.raises(RuntimeError):
        components(path, rounds=1)
