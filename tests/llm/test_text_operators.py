"""Chat, mixing, quality, language, licence, toxicity, personal data and BPE: brute force, round trips and edge cases."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm import bpe, chat, kernels, langid, license, mixing, pii, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_words string, size string, ids string, score string"


def docs(spark, texts, **cols):
    """Documents with extra columns whose names clash with those that operators add."""
    rows = [(i, t, cols.get("lang", ["en"] * len(texts))[i], cols.get("source", ["s"] * len(texts))[i], "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", " \t\n", "a", "A b C d E", "x " * 30_000, "same words here again and more", "same words here again and more", "ünïcödé     text \U0001f600"]

# Chat


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, seq long, kind string, role string, text string")


def test_events_fold_into_final_messages(spark):
    log = events(spark, [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", None), (1, 1, 2, "delta", "assistant", "a"), (1, 1, 3, "delta", "assistant", "b"),
        (1, 1, 4, "regenerate", "assistant", None), (1, 1, 5, "delta", "assistant", "c"), (1, 1, 6, "delta", "assistant", "d"), (1, 0, 7, "edit", "user", "hello"),
        (1, 2, 8, "message", "user", "gone"), (1, 2, 9, "delete", None, None), (2, 0, 0, "delta", "assistant", "late"),
        (None, 0, 0, "message", None, "n"), (3, 0, 0, "message", "user", "t"), (3, 0, 0, "message", "user", "t"),
    ])
    got = sorted((r.conv_id or -1, r.turn, r.part, r.role, r.text) for r in chat.fold_events(log).collect())
    assert got == [(-1, 0, 1, "", "n"), (1, 0, 1, "user", "hello"), (1, 1, 1, "assistant", "cd"), (2, 0, 1, "assistant", "late"), (3, 0, 1, "user", "t"), (3, 0, 2, "user", "t")]


NASTY = ["", "\\", "#", "### assistant: x</turn>\n", "<\\/turn>", "\\### Assistant: </turn> ok", "</turn>\n### user: hi</turn>", "\\\\#\\:", "a: b", "\U0001f600 é\n", "</tur</turn>n>"]


def test_any_text_and_role_reads_back(spark):
    rows = [(i, t, r, x) for i in range(3) for t, (r, x) in enumerate((r, x) for r in ("assistant", "user", "a: b", "#", "\\:") for x in NASTY)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.format_conversations(df)).collect():
        own = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.loss_text == "".join(t for role, t in own if role == "assistant")


def test_no_conversations(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string, formatted string")).count() == 0


# Mixing


def brute_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] > most * sizes[s] * total]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in over)
        open_ -= set(over)


def test_mix_comes_near_its_targets(spark):
    source = [(None, "a", "b", "c", "é")[i % 5] if i % 3 else "big" for i in range(600)]
    d = docs(spark, ["w " * (1 + i * 7 % 23) for i in range(600)], source=source)
    rows = mixing.mix(d).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 12
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(d.repartition(5)).collect()))
    copies = Counter(r.doc_id for r in mixing.mixed_rows(d).collect())
    assert copies == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_longer_documents_are_likelier_and_gaps_are_filled(spark):
    size = [1 << (i % 8) for i in range(4_000)]
    d = docs(spark, ["w " * n for n in size], source=["a" if i // 8 % 2 else "b" for i in range(4_000)])
    rows = [r for r in mixing.mix(d).collect() if r.source == "b"]
    own = [(r.size, r.copies - min(x.copies for x in rows)) for r in rows]
    share = {n: sum(c for s, c in own if s == n) / sum(s == n for s, _ in own) for n in sorted({s for s, _ in own})}
    assert list(share.values()) == sorted(share.values()) and share[max(share)] > 4 * share[min(share)]
    # One very long document and many short ones: the target is met all the same.
    for k in (0, 3):
        d = docs(spark, ["w " * 5_000, *["w " * 20] * 200, *["w " * 30] * 40 * (k + 1)], source=["a"] * 201 + ["b"] * 40 * (k + 1))
        rows = mixing.mix(d, seed=k).collect()
        for s in "ab":
            assert abs(sum(r.taken for r in rows if r.source == s) - next(r.target for r in rows if r.source == s)) <= 30


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [None, "", " "])).collect()] == [0, 0, 0]
    assert [r.size for r in mixing.mix(docs(spark, EDGES)).orderBy("doc_id").collect()] == [len(WORD.findall(t or "")) for t in EDGES]


# Quality


def brute_statistics(t):
    w = WORD.findall(t or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = {p for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    rows = [x for x in (t or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(rows) - len(set(rows)), len(twice))


def test_statistics_match_brute_force(spark):
    texts = [*EDGES, "a b c d e f a b c d e", "a b c d e " * 3, "l1 #\nl1 #\n\nl2\r\nl2\r\n \n", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 0 3 4 5 0 3 4"]
    for r in quality.statistics(docs(spark, texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(texts[r.doc_id])


def test_rules_are_learned_and_keep_clean_rows(spark):
    texts = [f"doc{i} has {'#' * 3 if i % 4 == 0 else 'fine'} words number{i} which {i} differ from those of other{i} rows by value{i} and so on{i}" for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(0, None), (None, 1)], "doc_id long, quality int")
    d = docs(spark, texts)
    rules = quality.learn(d, labels)
    assert rules and all(r.good == 0 for r in rules)
    assert {r.doc_id for r in quality.apply_rules(d, rules).where("not kept").collect()} == {i for i in range(400) if i % 4 == 0}
    kept = quality.kept_rows(d, rules)
    assert kept.columns == d.columns and kept.count() == 300
    assert quality.learn(d, labels.where("quality = 1")) == [] and quality.learn(d.limit(0), labels) == []
    assert quality.apply_rules(docs(spark, [None, ""]), []).where("kept").count() == 0


# Language


def test_languages_are_told_apart(spark):
    words = {"en": "the house and that with which they were", "de": "das haus und nicht mit welche sie waren schön", "fr": "la maison et que avec lesquels étaient"}
    texts = [" ".join(words[k].split()[i % 5 :] + words[k].split()[: i % 7]) for i in range(40) for k in words]
    lang = [k for _ in range(40) for k in words]
    d = docs(spark, texts, lang=lang)
    model = langid.train(d.where("doc_id < 60"))
    got = langid.predict(d, model).collect()
    assert all(r.lang_pred == lang[r.doc_id] and 0 <= r.score <= 1 for r in got) and len(got) == 120
    odd = langid.predict(docs(spark, [None, "", "123 !?", "...", "the house " * 50_000]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd] == ["und"] * 4 + ["en"]
    none = langid.train(d.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(d, none).collect()} == {"und"}


def brute_bayes(train, texts, orders=(1, 2, 3), bits=14):
    """Naive Bayes by counters, with the same n-grams and bins: log-odds summed text by text."""
    import math
    import unicodedata

    def bins(t):
        t = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in f" {t} ".lower())
        t = re.sub(" +", " ", t)
        out = []
        for n in orders:
            for i in range(len(t) - n + 1):
                h = 0
                for c in t[i : i + n]:
                    h = (h * kernels.BASE + ord(c) + 1) % 2**64
                x = (h + n) % 2**64
                x = (x ^ x >> 30) * kernels.MIX_1 % 2**64
                x = (x ^ x >> 27) * kernels.MIX_2 % 2**64
                out.append((x ^ x >> 31) >> (64 - bits))
        return out

    langs = sorted({x for _, x in train})
    seen = {k: Counter() for k in langs}
    rows = Counter(x for _, x in train)
    for t, k in train:
        seen[k].update(bins(t))
    total = {k: sum(seen[k].values()) + 0.5 * 2**bits for k in langs}
    prior = {k: math.log((rows[k] + 1) / (len(train) + len(langs))) for k in langs}
    out = []
    for t in texts:
        score = {k: prior[k] + sum(math.log((seen[k][b] + 0.5) / total[k]) for b in bins(t)) for k in langs}
        best = max(score.values())
        out.append((min(k for k in langs if score[k] == best), 1 / sum(math.exp(x - best) for x in score.values())))
    return out


def test_languages_match_brute_force_with_odd_characters(spark):
    words = {"en": "the house and that with which they were", "de": "das haus und nicht mit welche sie waren schön", "fr": "la maison et que avec lesquels étaient"}
    train = [(f"{w} {i}", k) for k, v in words.items() for i, w in enumerate(v.split())]
    texts = ["x\0" + words["de"], words["fr"], words["en"], "\0\0", "a\0b", "İstanbul das", "½²①", "、。", "日本", "no\0 la maison", "Ünd"]
    model = langid.train(docs(spark, [t for t, _ in train], lang=[k for _, k in train]))
    got = [(r.lang_pred, r.score) for r in langid.predict(docs(spark, texts), model).orderBy("doc_id").collect()]
    und = {3, 6, 7}
    for i, (have, want) in enumerate(zip(got, brute_bayes(train, texts))):
        assert have[0] == ("und" if i in und else want[0]) and abs(have[1] - (0 if i in und else want[1])) < 1e-9, texts[i]
    with pytest.raises(ValueError):
        langid.train(docs(spark, ["t"] * 600, lang=[str(i) for i in range(600)]))


# Licences


def test_licence_spellings_lines_and_marks_do_not_matter(spark):
    mit = license.TEXTS[0][1]
    texts = [mit, "Copyright (c) 2020 A B\nAll rights reserved.\n\n" + mit.upper().replace(" ", "\n "), mit.replace("MIT License", "MIT Licence").replace(",", ";"), mit + " more", None, "", "prose\nLicensed under the Apache License, Version 2.0.\nend"]
    got = license.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["MIT"] * 3 + [None] * 4
    assert [r.notices for r in got] == [""] * 6 + ["Apache-2.0"]


def test_licence_notices_and_headings_are_known_by_what_they_say(spark):
    mit = f"{license._MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {license._AS_IS}"
    bsd3 = f"{license._BSD_HEAD} {license._BSD_THIRD} {license._BSD_TAIL}"
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + license._ISC
    free = isc.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
    whole = {
        f"The MIT License (MIT)\n\nCopyright (c) 2020 A B\n\n{mit}": "MIT", isc: "ISC", f"BSD Zero Clause License\n\n{free}": "0BSD", f"BSD 3-Clause License\n\nCopyright (c) 2020, A B\n\n{bsd3}": "BSD-3-Clause",
        f"BSD 2-Clause License\n\n{bsd3.replace(license._BSD_THIRD + ' ', '')}": "BSD-2-Clause", f"Our own terms\n\n{mit}": None,
    }
    lines = {
        "Released under the MIT License.": "MIT", "This project is distributed under the terms of the Apache Licence, version 2.0": "Apache-2.0", "Available under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "# released under the GNU General Public License, version 3": "GPL-3.0", "Not released under the MIT License.": "", "Released under the MIT License.\nmore\nPublished under CC BY 4.0": "CC-BY-4.0,MIT", "a house under the hill": "",
    }
    got = [(r.license, r.notices) for r in license.scan(docs(spark, [*whole, *(f"prose\n{x}\nend" for x in lines)])).orderBy("doc_id").collect()]
    assert got[: len(whole)] == [(x, "") for x in whole.values()]
    assert got[len(whole) :] == [(None, x) for x in lines.values()]
    some = license.NOTICES[::29] + license.NOTICES[-12:]
    assert [r.notices for r in license.scan(docs(spark, [t for _, t in some])).orderBy("doc_id").collect()] == [n for n, _ in some]


# Toxicity


def brute_segments(s):
    """All maximal segments by their definition: repeatedly the best one, then left and right of it."""
    best, at = 0.0, None
    for a in range(len(s)):
        total = 0.0
        for b in range(a, len(s)):
            total += s[b]
            if total > best + 1e-12 or (at and abs(total - best) <= 1e-12 and b - a < at[1] - at[0] - 1):
                best, at = total, (a, b + 1)
    if at is None:
        return []
    a, b = at
    return brute_segments(s[:a]) + [(a, b, best)] + [(x + b, y + b, z) for x, y, z in brute_segments(s[b:])]


def test_segments_match_their_definition():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        s = np.round(rng.normal(-0.3, 1, rng.integers(0, 25)), 3) + rng.uniform(0, 1e-6)
        got = toxicity.segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(s.tolist())]


def test_toxic_words_are_learned(spark):
    import random

    r = random.Random(3)
    base = [" ".join(f"w{r.randrange(300)}" for _ in range(60)) for _ in range(600)]
    texts = [t + (" you vile rotten fool" if i % 5 == 0 else "") for i, t in enumerate(base)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int")
    d = docs(spark, [*texts, None, ""])
    model = toxicity.learn(d, labels)
    got = {x.doc_id: x for x in toxicity.score_rows(d, model, text_col="text").collect()}
    held = range(500, 600)
    assert all((got[i].score >= 0.7) == (i % 5 == 0) for i in held)
    assert all(len(got[i].passages) == (i % 5 == 0) for i in held)
    assert got[600].score < 0.5 and got[601].score < 0.5
    none = toxicity.learn(d, labels.limit(0))
    assert {x.score for x in toxicity.score_rows(d, none, text_col="text").collect()} == {0.0}


# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(t):
    out = []
    for k, (name, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


PII = [
    *EDGES, "a@b.c_d@e.f x@y x@y.z. @a.b", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.01.1 1.2.3 00000000000000000001.1.1.1", "4111 1111 1111 1111 4111111111111111 4111-1111-1111-1112 41111111111111111111111",
    "+1 (555) 555-0100 +1 2 +123456789012345678 ++44 20 7946 0958 +1+2(3)4567890", "\U0001f600 é me@x.org 😀 10.0.0.1", "9" * 5_000, "a@" * 3_000, "a." * 4_000 + "@x", "x@a" + ".b" * 3_000, "1 " * 5_000, "+1" * 3_000, "0" * 12 + " " + "0" * 19,
]


def test_base_spans_match_brute_force(spark):
    rows = pii.report(docs(spark, [*PII, PII[13]])).collect()
    assert len(rows) == len(PII) + 1
    for r in rows:
        want = brute_spans([*PII, PII[13]][r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r.doc_id
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_contexts_of_known_entities_find_unknown_ones(spark):
    texts = ["intro words member id: AB12345X end", "intro words order number AB99999X end"]
    known = [f"member id: user{i}@mail.org end" for i in range(30)]
    got = {r.doc_id: r for r in pii.report(docs(spark, [*texts, *known])).collect()}
    assert got[0].n_id == 1 and got[0].spans == "id:23:31" and got[1].n_id == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, [*texts, *known, None])).collect()}
    assert clean[0] == "intro words member id: [ID] end" and clean[2] == "member id: [EMAIL] end" and clean[32] is None


def test_tokens_of_any_length_are_found_whole(spark):
    tokens = ["q" * 20 + "123", "sess-" + "ab12" * 40, "abcdefgh-ijklmnop-qrstuv-00123", "A" * 3_000 + "-" + "9" * 300, "k" + "1" * 5_000]
    known = [f"member id: user{i}@mail.org end" for i in range(30)]
    odd = ["a-" * 20_000, "a--" * 20_000, "a_" * 20_000, "1-" * 20_000 + "x", "x" * 100_000, "member id: ab-12 x"]
    got = {r.doc_id: r.text for r in pii.redact(docs(spark, [*(f"a member id: {t} end" for t in tokens), *known, *odd])).collect()}
    assert [got[i] for i in range(len(tokens))] == ["a member id: [ID] end"] * len(tokens)
    assert [got[len(tokens) + len(known) + i] for i in range(len(odd))] == odd


def test_bootstrapping_goes_on_as_long_as_it_learns(spark):
    # Each link's pattern shares its tokens with the one before, and is trusted only once that one is.
    links = [f"word link{chr(97 + k)}: tok{k + j}{i:03d}x end" for k in range(8) for j in (0, 1) for i in range(3)]
    seeds = [f"word linka: u{i}@mail.org end" for i in range(6)]
    got = pii.report(docs(spark, [*links, *seeds])).collect()
    assert all(r.n_id == 1 for r in got if r.doc_id < len(links))


def test_contexts_are_whole_words(spark):
    long = "w" * 60
    known = [f"{a}{long} {long}: user{i}@mail.org end" for i in range(5) for a in "a"]
    got = {r.doc_id: r.n_id for r in pii.report(docs(spark, [f"a{long} {long}: AB12345X end", f"x {long[:-1]}: AB99999X end", *known])).collect()}
    assert (got[0], got[1]) == (1, 0)


def test_rows_that_repeat_and_empty_tables(spark):
    d = docs(spark, ["call +1 555 555 0100", None])
    twice = pii.report(d.union(d)).collect()
    assert sorted((r.doc_id, r.n_phone) for r in twice) == [(0, 1), (0, 1), (1, 0), (1, 0)]
    assert pii.report(d.limit(0)).count() == 0
    assert pii.report(d.withColumn("doc_id", F.lit(None).cast("long"))).agg(F.sum("n_phone")).first()[0] == 1


# BPE

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")


def test_ids_are_those_of_whole_texts_and_decode(spark):
    enc = bpe.encoder(RANKS, P.PATTERN)
    texts = [*EDGES, "don't  stop\n\n  now\t\tx", "word " * 40_000, "a" * 3_000, "\x1c!\x1c \x1d", "中文" * 500, "  \n " * 2_000 + "x"]
    d = docs(spark, texts)
    out = bpe.encode_documents(d, RANKS, P.PATTERN, digests=True, piece=97)
    for r in bpe.decode_documents(out, RANKS, P.PATTERN).collect():
        want = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == (texts[r.doc_id] or "").encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert bpe.encode_documents(d.limit(0), RANKS, P.PATTERN).count() == 0


def test_very_long_white_space(spark):
    enc = bpe.encoder(RANKS, P.PATTERN)
    runs = [" " * 2_000_000, "\t" * 300_000, " \n\t\u3000" * 100_000, "\x1c " * 50_000]
    texts = [a + r + b for r in runs for a, b in (("", ""), ("x", ""), ("", "y"), ("don't", "we're ok"), ("a ", ".\n"))]
    # Each match of the pattern by itself: a run is one up to its last character, and what follows starts with that.
    short = [a + r[:6_000] + b for r in runs for a, b in (("x", ""), ("", "y"), ("a ", "b"))]
    for r in bpe.encode_documents(docs(spark, texts + short), RANKS, P.PATTERN, digests=True).collect():
        t = (texts + short)[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        if r.doc_id >= len(texts):
            assert r.ids == enc.encode_ordinary(t)
    assert bpe.encode("x" + runs[0] + "y", bpe._encodings(open(RANKS, "rb").read(), P.PATTERN)) == enc.encode_ordinary("x") + enc.encode_ordinary(" ") * 1_999_999 + enc.encode_ordinary(" y")


def test_words_hash_alike_where_they_are_alike():
    doc, (h, p) = kernels.words([b"Abc abc  ABC\tabcd", b"", b"abc"], (3,))
    assert doc.tolist() == [0, 0, 0, 0, 2] and len(set(h[[0, 1, 2, 4]].tolist())) == 1 and h[3] != h[0]
    assert len(set(p.tolist())) == 1


def test_redaction_keeps_columns_of_any_name(spark):
    kind = "doc_id long, text string, _h long, _id string, _hash string, _spans string, _row string, _t string, `a.b` string, `c``d` string"
    df = spark.createDataFrame([(1, "mail a@b.org now", 5, "i", "h", "s", "r", "t", "x", "y"), (2, None, 6, "i", "h", "s", "r", "t", "x", "y"), (None, "no", 7, None, None, None, None, None, None, None)], kind)
    got = pii.redact(df)
    assert got.columns == df.columns
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert rows == {1: (1, "mail [EMAIL] now", 5, "i", "h", "s", "r", "t", "x", "y"), 2: (2, None, 6, "i", "h", "s", "r", "t", "x", "y"), None: (None, "no", 7, *[None] * 7)}
