"""Toxicity by maximum-scoring segments.

Words and their beginnings (which stand for stems) get log-odds of standing in toxic and clean documents, shrunk by a
Dirichlet prior in proportion to the whole sample; those whose odds are clearly positive form a lexicon. A
token takes the odds of its longest form in the lexicon, and any other token costs a little. In each
text a linear-time scan (after Ruzzo and Tompa) finds all maximal segments of positive sum. Extreme-value theory gives
the number of segments of such a score that a clean text of its length shows by chance, and of such a sum of several
scores (Karlin and Altschul, 1993). A logistic curve, fitted on labelled rows that the lexicon has not seen, turns the
evidence of the best number of segments into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import kernels
from riskloom.llm.quality import labelled_sample
from riskloom.llm.shared import blocks, cut

#: Bound on the labelled rows that learning uses.
SAMPLE = 20_000
#: What a token costs that the lexicon doesn't hold, the standard scores that it asks for, and the prior's share of all documents.
COST, Z, PRIOR = 0.5, 4.0, 0.1
#: The least odds of a lexicon entry, two standard errors below its estimate.
LEAST = 1.0
#: A passage is significant if a clean text of its length shows fewer such passages than this.
E_VALUE = 0.05
#: Bytes of the beginnings of words.
STEMS = (6, 5, 4)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document number of each token and the keys of its forms, longest first.

    Tokens are runs of ASCII letters and digits (A-Z lowered) and of characters beyond ASCII. Forms differ in their keys
    even where they are the same string, so that a short word isn't taken for a stem.
    """
    doc, forms = kernels.words([t.translate(PLAIN) for t in texts], STEMS)
    return doc, [kernels.mix(h + np.uint64(i)) for i, h in enumerate(forms)]


#: By byte, ASCII marks and controls become spaces.
PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments of positive sum as (start, end, sum), in order, in time linear in the scores.

    Runs of positive scores stand for their tokens; each candidate keeps the place where the search for one that starts
    from a lower running sum ended, so that no part of the list is searched twice.
    """
    positive = score > 0
    edge = np.diff(positive.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([[0.0], np.cumsum(score, dtype=float)])
    found: list[list] = []  # start, end, running sum before, running sum after, place of the last one with a lower sum before
    for a, b, low, high in zip(starts.tolist(), ends.tolist(), sums[starts].tolist(), sums[ends].tolist()):
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][2] >= low:
                at = found[at][4]
            if at < 0 or found[at][3] >= high:
                break
            a, low = found[at][0], found[at][2]
            before = found[at][4]
            del found[at:]
            at = before
        found.append([a, b, low, high, at])
    return [(a, b, high - low) for a, b, low, high, _ in found]


def learn(docs: DataFrame, labels: DataFrame, allowed=None, most: int = SAMPLE, text_col: str = "text") -> dict:
    """A model from at most `most` labelled rows (toxic 1 or 0); `allowed` filters label rows first.

    Of sampled copies and near copies (texts with one smallest shingle hash) with one label the one of the smallest id stays
    (then of the smallest hash of its text), or their words would seem telling.
    Two thirds of the sample make the lexicon, the rest the calibration. Their ids are broadcast: `most` bounds them.
    Without both classes every score is 0.
    """
    sample = labelled_sample(labels.where(allowed) if allowed is not None else labels, "toxic", most)
    part = (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) == 0).alias("_held")
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "doc_id").select("doc_id", (F.col("toxic") > 0).alias("_toxic"), part, "_text").mapInArrow(_families, "doc_id bigint, _toxic boolean, _held boolean, _text string, _family bigint").groupBy("_family", "_toxic").agg(F.min_by(F.struct("_held", "_text"), F.struct("doc_id", F.xxhash64("_text"))).alias("_r")).select("_toxic", "_r._held", "_r._text"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = kernels.as_bytes(batch.column(1)), np.array(batch.column(0).to_pylist(), bool)
            for a, b in blocks([len(t) for t in texts], kernels.BLOCK):
                doc, forms = tokens(texts[a:b])
                doc, h = np.tile(doc, len(forms)), np.concatenate(forms)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])[: len(h)]
                word, at = np.unique(h[first], return_inverse=True)
                bad = toxic[a:b][doc[first]]
                n = [np.bincount(at[bad == k], minlength=len(word)) for k in (True, False)]
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n[0], pa.int64()), pa.array(n[1], pa.int64())], ["word", "bad", "good"])

    own = rows.where("not _held").select("_toxic", "_text")
    n_bad, n_good = own.agg(F.count_if(F.col("_toxic")), F.count_if(~F.col("_toxic"))).first()
    model = {"words": np.zeros(0, np.uint64), "score": np.zeros(0), "fit": None}
    if not n_bad or not n_good:
        return model
    prior = PRIOR * (n_bad + n_good)
    counts = own.mapInArrow(count, "word bigint, bad bigint, good bigint").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = (F.col("bad") + F.col("good")) / (n_bad + n_good) * prior
    odds = lambda n, total: F.log((F.col(n) + share) / (F.lit(total + prior) - F.col(n) - share + 1))
    error = F.sqrt(1 / (F.col("bad") + share) + 1 / (F.col("good") + share))
    lexicon = counts.select("word", (odds("bad", n_bad) - odds("good", n_good)).alias("delta"), error.alias("error")).where((F.col("delta") > Z * F.col("error")) & (F.col("delta") - 2 * F.col("error") > LEAST)).toArrow()
    word, delta, error = (lexicon.column(i).to_numpy() for i in range(3))
    order = np.argsort(word.view(np.uint64))
    model |= {"words": word.view(np.uint64)[order], "score": (delta - 2 * error)[order]}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.as_bytes(batch.column(0))
            for a, b in blocks([len(t) for t in texts], kernels.BLOCK):
                value, n = np.unique(np.round(token_scores(texts[a:b], model)[1], 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n, pa.int64())], ["value", "n"])

    clean = rows.where("_held and not _toxic").select("_text").mapInArrow(spread, "value double, n bigint").groupBy("value").agg(F.sum("n").alias("n")).toArrow()
    model["rate"] = _rate(clean.column(0).to_numpy(), clean.column(1).to_numpy())
    held = score_rows(rows.where("_held"), model, keep=("_toxic",)).select("_toxic", "best", "n_tokens").toArrow()
    toxic, best, n = (held.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    clean = ~toxic.astype(bool)
    if clean.all() or not clean.any():
        return model
    model["k"] = 1 / max(np.mean(np.maximum(n[clean], 1) * np.exp(-model["rate"] * best[clean])), 1e-12)
    told = score_rows(rows.where("_held"), model, keep=("_toxic",)).select("_toxic", "evidence").toArrow()
    model["fit"] = _logistic(told.column(1).to_numpy(), told.column(0).to_numpy(zero_copy_only=False).astype(float))
    return model


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of each text's word shingles."""
    for batch in batches:
        texts = kernels.as_bytes(batch.column(3))
        least = [int(own.view(np.int64)[0]) if len(own) else 0 for a, b in blocks([len(t) for t in texts], kernels.BLOCK) for own in kernels.shingle_sets(texts[a:b])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "_family"])


def _rate(score: np.ndarray, n: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 over the tokens of clean texts."""
    share = n / max(n.sum(), 1)
    value = lambda x: (share * np.exp(np.minimum(x * score, 500))).sum() - 1
    low, high = 1e-3, 8.0
    if value(low) >= 0:
        return low
    if value(high) <= 0:
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def evidence(sums: list[float], n: int, model: dict) -> float:
    """Minus the log of the expected number of such segments in a clean text of n tokens.

    One segment of sum s has x = rate * s - log(k * n). The r best, with x above 0, have T, the sum of their x, and the
    evidence T - (r - 1) log T + log(r! (r - 1)!), less log 2 for each r tried. The best r counts.
    """
    x = [model["rate"] * s - math.log(model["k"] * max(n, 1)) for s in sorted(sums, reverse=True)] or [-math.log(model["k"] * max(n, 1))]
    best, total = x[0], x[0]
    for r, more in enumerate(x[1:], 2):
        if more <= 0:
            break
        total += more
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
    return best


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of a lightly penalised logistic curve, by Newton's method."""
    scale = max(float(np.std(x)), 1e-9)
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]) / scale, 0.0), float(w[1])


def token_scores(texts: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Document number and score of each token."""
    doc, forms = tokens(texts)
    value = np.full(len(doc), -COST)
    for h in reversed(forms if len(model["words"]) else []):
        at = np.minimum(np.searchsorted(model["words"], h), len(model["words"]) - 1)
        hit = model["words"][at] == h
        value[hit] = model["score"][at[hit]]
    return doc, value


def passages(texts: list[bytes], model: dict) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """For each text its number of tokens and its maximal segments, in token numbers."""
    doc, value = token_scores(texts, model)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield b - a, segments(value[a:b])


def score_rows(docs: DataFrame, model: dict, text_col: str = "_text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, with n_tokens, best (the highest segment sum, 0 without one), evidence (of all segments, 0 from
    a model without calibration), passages (start, end, sum of each significant one, in tokens) and score (0 to 1) for every row; a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(text_col).alias("_scored"), *keep)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64())]))
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("_scored").schema] + ["n_tokens bigint, best double, evidence double, passages array<struct<start:bigint,end:bigint,sum:double>>, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = kernels.as_bytes(batch.column(0))
            n, found = [], []
            for a, b in blocks([len(t) for t in texts], kernels.BLOCK):
                for size, own in passages(texts[a:b], m):
                    n.append(size)
                    found.append(own)
            best = np.array([max((s for _, _, s in own), default=0.0) for own in found], float)
            all_of_it = np.array([evidence([s for _, _, s in own], k, m) if "k" in m else 0.0 for k, own in zip(n, found)], float)
            if m["fit"]:
                p = 1 / (1 + np.exp(-np.clip(m["fit"][0] * all_of_it + m["fit"][1], -30, 30)))
                told = [[{"start": int(a), "end": int(b), "sum": s} for a, b, s in own if m["k"] * max(k, 1) * np.exp(-m["rate"] * s) < E_VALUE] for k, own in zip(n, found)]
            else:
                p, told = np.zeros(len(n)), [[] for _ in n]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(best), pa.array(all_of_it), pa.array(told, kind), pa.array(p, pa.float64())], [*keep, "n_tokens", "best", "evidence", "passages", "score"])

    return src.mapInArrow(run, out)
