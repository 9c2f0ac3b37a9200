"""Ranked search, packed token files and alignment of tokenizers: brute force, round trips and edge cases."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import align, lexical, tokenfile, wordwise

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, start string, n_tokens string, score string, row string, `a.b` int"
#: White space of all kinds, marks, bytes that aren't letters in ASCII, names of special tokens, and long runs.
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "\n a", "a  b", "a 　 b", "tab\t x", "x \x1c y", "it's  we'll", "<|endoftext|> and <|endoftext|>x", "<s> </s> <unk>", "▁ piece ▁", "mid▁dle",
    "日本語 の テキスト", "é é ﬁ \U0001f600\U0001f600", "a" * 5_000, "ab " * 3_000, " " * 5_000 + "x", "\x00 nul", "1.5 -.", "<0x41> A", "\r\n  end\n",
]


def rows(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", 1) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def prose(n, seed, words=300):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randrange(2, 9))) for _ in range(words)]
    pick = lambda: vocabulary[min(int(r.expovariate(0.02)), words - 1)] + r.choice(["", "", "", ".", ",", "'s"])
    return [" ".join(pick() for _ in range(r.choice([3, 20, 60]))) for _ in range(n)]


# Words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab'1. \n\t ▁é\x1c　")), max_size=12)), max_size=6))
def test_words_joined_by_spaces_are_the_text(texts):
    s = wordwise.split(pa.array(texts, pa.string()))
    assert [" ".join(s.words[i] for i in s.at[a:b]) for a, b in zip(s.bounds[:-1], s.bounds[1:])] == [t or "" for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abZ'1. -\n\t é日\x1c　<|>")), max_size=40))
def test_ids_word_by_word_are_those_of_the_whole_text(text):
    from tokenizers import Tokenizer

    with open(BYTE_BPE, "rb") as f:
        got = tokenfile.encode(pa.array([text]), f.read())[0].tolist()
    assert got == Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids


def test_few_words_are_remembered():
    calls = []
    kept = wordwise.Remembered(lambda words: [calls.append(w) or w.upper() for w in words], 2)
    long = "x" * 100
    assert kept(["a", "b", "a", long]) == ["A", "B", "A", long.upper()] and kept(["a", "c", long]) == ["A", "C", long.upper()]
    assert len(kept.known) <= 2 and calls.count(long) == 2


# Ranked search


def brute_ranks(texts, items, top=20):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [(i, Counter(find.findall((t or "").translate(low)))) for i, t in texts]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = find.findall((text or "").translate(low))
        scored = []
        for i, c, n in held:
            m = 100 - 25 + ((25 * n * n_docs) // total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            scored += [(-s, i is None, i or 0)] if s > 0 else []
        out += [(item, k + 1, None if no else i, -s) for k, (s, no, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"POSTINGS": 40, "FIRST": 1, "ITEM_TERMS": 30}])
def test_ranks_match_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    texts = prose(150, 1)
    texts += [texts[3]] * 30 + ODD + ["İ K É é ab-AB", "only here"]
    ids = [*range(len(texts) - 3), 7, None, 7]
    items = [(i, t) for i, t in enumerate(prose(12, 2))] + [(100, texts[3]), (100, None), (101, ""), (102, "no such words zzz"), (None, "only ONLY here"), (103, "ab AB ab é")]
    asked = spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id long, text string, rank string, `a.b` int")
    got = [tuple(r) for r in lexical.search(rows(spark, texts, ids), asked).collect()]
    assert sorted(got, key=str) == brute_ranks(list(zip(ids, texts)), items)


def test_search_without_rows(spark):
    docs, items = rows(spark, ["a b"]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(rows(spark, [None, "", "-"]), items).count() == 0


def test_best_positions_stop_early_and_beat_last_read_positions():
    r = np.random.default_rng(0)
    n, terms = 20_000, 6
    doc, term = np.repeat(np.arange(n), terms), np.tile(np.arange(terms), n)
    impact = (r.pareto(1.0, n * terms) * 1000).astype(np.int64) + 1
    lists = lexical.Lists.of(doc, term, impact, n, terms)
    work = lexical.Work()
    docs, scores = lexical.best_positions(lists, np.arange(terms), np.ones(terms, np.int64), 20, work)
    every = np.bincount(doc, impact).astype(np.int64)
    assert sorted(scores.tolist())[-20:] == sorted(every.tolist())[-20:] and (every[docs] == scores).all()
    assert work.postings == n * terms and work.read < work.postings / 10


# Token files


@pytest.mark.parametrize("width", [1, 2, 7, 8, 13, 16, 17, 25, 31, 32])
def test_packing_reads_back_at_any_place(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 10_000, dtype=np.uint64).astype(np.uint32)
    raw = np.frombuffer(tokenfile.pack(ids, width), np.uint8)
    assert len(raw) == -(-10_000 * width // 8) and (tokenfile.unpack(raw, width, len(ids)) == ids).all()
    assert (tokenfile.unpack(raw, width, 77, 4_321) == ids[4_321:4_398]).all() and len(tokenfile.unpack(raw, width, 0, 5)) == 0
    lists = [ids[:0], ids[:5], ids[5:9_000], ids[9_000:]]
    f = tokenfile.TokenFile(tokenfile.file_bytes([None, 3, 3, -9], lists, width) + b"\n")
    assert f.doc_ids == [None, 3, 3, -9] and all((f.document(i) == x).all() for i, x in enumerate(lists))
    assert (f.ids(4_090, 8_200) == ids[4_090:8_200]).all() and len(f.ids(10_000, 10_001)) == 0


def test_ids_beyond_the_width_are_an_error():
    with pytest.raises(ValueError):
        tokenfile.file_bytes([1], [np.array([8], np.uint32)], 3)
    assert [tokenfile.width_of(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize("limits", [{}, {"FILE_IDS": 300, "PART_BYTES": 4_000}])
def test_token_files_hold_whole_texts_in_order(spark, tmp_path, monkeypatch, limits):
    from tokenizers import Tokenizer

    for name, value in limits.items():
        monkeypatch.setattr(tokenfile, name, value)
    texts = ODD + prose(60, 3)
    ids = [None, *random.Random(1).sample(range(-50, 1_000), len(texts) - 1)]
    path = str(tmp_path / "files")
    tokenfile.write_tokens(rows(spark, texts, ids), path, BYTE_BPE)
    tok = Tokenizer.from_file(BYTE_BPE)
    want = sorted(((-(10**9) if i is None else i), tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in zip(ids, texts))
    got = tokenfile.with_starts(tokenfile.documents(spark, path, keep_ids=True)).orderBy("start").collect()
    assert [(-(10**9) if r.doc_id is None else r.doc_id, r.ids) for r in got] == want
    start = 0
    for r, (_, own) in zip(got, want):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    # Names of files are in the order of documents.
    names = sorted(glob.glob(f"{path}/part-*"))
    stored = [i for n in names for i in tokenfile.TokenFile(open(n, "rb").read()).doc_ids]
    assert stored == [r.doc_id for r in got] and (len(names) > 4 if limits else True)
    every = [x for _, own in want for x in own]
    index = tokenfile.with_starts(tokenfile.documents(spark, path))
    for lo, hi in ((0, 5), (100, 900), (start - 3, start + 9), (7, 7)):
        assert tokenfile.read_range(spark, path, index, lo, hi).tolist() == every[lo:hi]


def test_repeated_rows_and_no_rows_in_token_files(spark, tmp_path):
    path = str(tmp_path / "files")
    tokenfile.write_tokens(rows(spark, ["x y", "x y", "z", "x y"], [5, 5, 5, 4]), path, BYTE_BPE)
    got = tokenfile.with_starts(tokenfile.documents(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [4, 5, 5, 5] and [r.start for r in got] == [0, 3, *sorted(r.start for r in got)[2:]]
    tokenfile.write_tokens(rows(spark, ["x"]).limit(0), str(tmp_path / "none"), BYTE_BPE)
    assert tokenfile.with_starts(tokenfile.documents(spark, str(tmp_path / "none"))).count() == 0


# Alignment


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(BYTE_BPE)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    names = align.byte_level_bytes([left.id_to_token(i) for i in range(left.get_vocab_size())])
    own = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        raw_a = [names[i] for i in a]
        raw_b = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            own.append(([], [], []))
            continue
        ends = [set(np.cumsum([len(x) for x in raw]).tolist()) for raw in (raw_a, raw_b)]
        groups, at, i, j = [], 0, 0, 0
        for stop in sorted(ends[0] & ends[1]):
            ga, gb, x, y = [], [], at, at
            while x < stop:
                ga.append(a[i])
                x, i = x + len(raw_a[i]), i + 1
            while y < stop:
                gb.append(b[j])
                y, j = y + len(raw_b[j]), j + 1
            groups.append((ga, gb))
            at = stop
        own.append((a, b, groups))
    links = [[(x, y) for ga, gb in g for x in ga for y in gb] for _, _, g in own]
    count = Counter(p for doc in links for p in set(doc))
    best = defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    out = []
    for (a, b, g), own_links in zip(own, links):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((len(a), len(b), len(g), len(own_links), sum(count[p] == best[p[0]] for p in own_links), sum(count[p] for p in own_links), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out


@pytest.mark.parametrize("limits", [{}, {"KNOWN": 40, "SUMMED": 16, "LISTED": 1}, {"KNOWN": 0}])
def test_alignment_matches_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(align, name, value)
    align.aligner.cache_clear()
    texts = ODD + prose(60, 4) + ["The quick brown fox, of course.", "Said the committee: it's 1,000 $ — naïve?"] + ["same words again"] * 5
    ids = [None, *range(10, len(texts) + 9)]
    got = align.align(rows(spark, texts, ids), BYTE_BPE, PIECES).collect()
    want = dict(zip(ids, brute_alignment(texts)))
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[r.doc_id], (r, texts[ids.index(r.doc_id)])
    assert any(w[0] for w in want.values())


def test_alignment_of_no_rows(spark):
    assert align.align(rows(spark, ["x"]).limit(0), BYTE_BPE, PIECES).count() == 0
    got = align.align(rows(spark, [None, ""]), BYTE_BPE, PIECES).collect()
    assert sorted((r.doc_id, r.n_a, r.n_links, r.count_sum, r.groups_sha256) for r in got) == [(0, 0, 0, 0, ""), (1, 0, 0, 0, "")]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcé1. \n▁日_'-")), max_size=30))
def test_groups_word_by_word_are_those_of_the_whole_text(text):
    with open(BYTE_BPE, "rb") as f, open(PIECES, "rb") as g:
        own = align.aligner(f.read(), g.read())
    totals, digests, *_ = own.documents([text])
    want = brute_alignment([text])[0]
    assert (*totals[0].tolist(), digests[0]) == (*want[:4], want[6])
