"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams for each language in Arrow batches; every task sends one row per language and bin, and a
`groupBy` adds them up, so training sees all labelled rows and what moves is bounded by tasks x languages x bins. The
matrix of log-probabilities (languages x bins, a bound set by parameters and the number of labels) is broadcast, and
scoring gathers from it with numpy for the n-grams that a text has.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import kernels
from riskloom.llm.shared import blocks

U = np.uint64
#: Labels that a model may have: with 2**14 bins of 8 bytes, 64 MB to broadcast at most.
MOST_LABELS = 512


def grams(texts: list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and document number of every character n-gram of the lower-case texts.

    Characters other than letters count as one space and runs of them as one: digits, marks and layout say little of a
    language. Each text has a space before and after it.
    """
    padded = [f" {t} ".lower() for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
    code = np.where(letters()[code], code, np.uint32(32))
    keep = (code != 32) | np.concatenate([[True], code[:-1] != 32])[: len(code)] | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(code)]
    doc, code = doc[keep], code[keep].astype(U)
    bins, docs = [], []
    h = np.zeros(len(code), U)
    for n in range(1, max(orders) + 1):
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * U(kernels.BASE) + code[n - 1 :] + U(1)
        if n in orders:
            same = doc[: len(h)] == doc[n - 1 :]
            bins.append((kernels.mix(h[same] + U(n)) >> U(64 - bits)).astype(np.int64))
            docs.append(doc[: len(h)][same])
    return (np.concatenate(bins), np.concatenate(docs)) if bins else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point, whether it is a letter: Unicode's categories L."""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)]))
    return _letters[0]


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", orders: tuple[int, ...] = (1, 2, 3), bits: int = 14) -> dict:
    """A model from all rows with a text and a label: labels in order, log-probabilities (labels x bins), log-priors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                total = seen.setdefault(lang, np.zeros(1 << bits, np.int64))
                n[lang] = n.get(lang, 0) + len(own)
                for a, b in blocks([len(t) for t in own], kernels.BLOCK):
                    total += np.bincount(grams(own[a:b], orders, bits)[0], minlength=1 << bits)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([n[lang], *total[at].tolist()], pa.int64())], ["lang", "bin", "n"])

    # A model has a row for each label: what is no short list of languages is refused rather than brought home.
    found = labelled.where(F.col(text_col).isNotNull()).select(lang_col).distinct().limit(MOST_LABELS + 1).count()
    if found > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {lang_col}")
    rows = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null")
    counts = rows.mapInArrow(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    lang, at, n = (counts.column(i).to_numpy() for i in range(3))
    names = sorted(set(lang.tolist()))
    if not names:
        return {"names": [], "logp": np.zeros((0, 1 << bits)), "prior": np.zeros(0), "orders": orders, "bits": bits}
    place = {x: i for i, x in enumerate(names)}
    row = np.array([place[x] for x in lang])
    table = np.zeros((len(names), 1 << bits))
    table[row[at >= 0], at[at >= 0]] = n[at >= 0]
    prior = np.zeros(len(names))
    prior[row[at < 0]] = n[at < 0]
    smooth = table + 0.5
    return {"names": names, "logp": np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True)), "prior": np.log(prior + 1) - np.log((prior + 1).sum()), "orders": orders, "bits": bits}


def score(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """Label and posterior probability of each text; `und` and 0 for a null text, one without a letter, or no model."""
    out, prob = ["und"] * len(texts), np.zeros(len(texts))
    todo = [i for i, t in enumerate(texts) if t and has_letter(t)] if model["names"] else []
    logp = np.ascontiguousarray(model["logp"].T)
    for a, b in blocks([len(texts[i]) for i in todo], kernels.BLOCK):
        bins, doc = grams([texts[i] for i in todo[a:b]], model["orders"], model["bits"])
        total = np.stack([np.bincount(doc, weights=logp[bins, k], minlength=b - a) for k in range(len(model["names"]))], axis=1) + model["prior"]
        best = total.argmax(axis=1)
        p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, k, x in zip(todo[a:b], best, p):
            out[i], prob[i] = model["names"][k], x
    return out, prob


def predict(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, lang_pred and score for every row; labels are no input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(text_col).alias("_text"), *keep)
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("_text").schema] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, p = score(batch.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(p, pa.float64())], [*keep, "lang_pred", "score"])

    return src.mapInArrow(run, out)
