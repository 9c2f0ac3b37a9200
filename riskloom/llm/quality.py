"""Quality rules: a fixed base rule and a decision list learned by sequential covering, in DataFrame operations only.

Spark computes text statistics of every whole document. Learning joins a bounded sample of labelled rows, cuts every
statistic at its quantiles, and brings home the count of good and bad rows in each cell of that grid. On these counts,
rules are grown condition by condition (FOIL gain) on two thirds of the sample and pruned on the other third; the
resulting list is plain data and compiles into one ordered CASE WHEN. Where no more rejecting rule is precise enough, a
keeping one may take out good rows, after which rejecting rules that would have hit them can be.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import SPACE, cut, whole_row

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Statistics that rules may test, each defined by `statistics`.
FEATURES = ("word_length", "symbol_share", "mark_share", "upper_share", "digit_share", "dup_line_share", "repeat_share", "line_words", "n_words")
#: Bound on the labelled rows that learning uses: those with the smallest hashes of their ids.
SAMPLE = 20_000


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects or keeps, with the sample's counts of bad and good rows that it was kept for."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int
    keeps: bool = False


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text column, with word counts, the base columns and the FEATURES; null texts count as empty.

    n_repeat_words counts the words that lie in a window of five words found twice or more. Windows are first told apart
    by hash; only a text in which two hashes agree is compared by its words, so the count is exact.
    """
    own = [c for c in docs.columns if c != text_col and c not in (*FEATURES, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = lambda keep: F.length(F.regexp_replace("_t", f"[^{keep}]+", "")).cast("long")
    d = docs.select(*own, text.alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(" \t\u000b\f\r")) != "")
    d = d.select(
        *own,
        F.filter(F.split("_t", SPACE), lambda w: w != "").alias("_w"),
        lines.alias("_l"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        left(r"#*$%&|<>").alias("n_symbols"),
        left(r"\p{P}\p{S}").alias("_marks"),
        left(r"\p{Lu}").alias("_upper"),
        left("0-9").alias("_digits"),
    )
    d = d.withColumns({"n_words": F.size("_w").cast("long"), "_lines": F.size("_l").cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "_h": F.transform("_w", lambda w: F.xxhash64(w))}).drop("_l")
    last = (F.col("n_words") - (WINDOW - 1)).cast("int")
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(-1, WINDOW - 1)]))
    d = d.withColumn("_x", F.when(F.col("n_words") >= WINDOW, windows))
    twice = (F.col("n_words") >= WINDOW) & (F.size(F.array_distinct("_x")) < F.size("_x"))
    exact = F.array_sort(F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.array_join(F.slice("_w", i, WINDOW), " ").alias("k"), i.alias("i"))))
    d = d.withColumn("_s", F.when(twice, exact)).drop("_x", "_h", "_w")
    same = lambda x, j: F.coalesce(F.get("_s", j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get("_s", j + 1)["k"] == x["k"], F.lit(False))
    at = F.array_sort(F.transform(F.filter("_s", same), lambda x: x["i"]))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["p"])).alias("n"), i.alias("p")), lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_s")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    shares = {"word_length": per("word_chars", "n_words"), "line_words": per("n_words", "_lines"), "repeat_share": per("n_repeat_words", "n_words"), "dup_line_share": per("n_dup_lines", "_lines")}
    shares |= {f"{k}_share": per(c, "word_chars") for k, c in (("symbol", "n_symbols"), ("mark", "_marks"), ("upper", "_upper"), ("digit", "_digits"))}
    return d.withColumns(shares).drop("_lines", "_marks", "_upper", "_digits")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled_sample(labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """At most `most` rows of doc_id and label: those with the smallest hash of the id. Ids labelled twice take the larger label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learn(docs: DataFrame, labels: DataFrame, bins: int = 16, most: int = SAMPLE, least_precision: float = 0.95, max_rules: int = 12, max_conditions: int = 4) -> list[Rule]:
    """A decision list from documents and their labels (quality 1: good, 0: bad); [] if a class is missing.

    The sample's ids are broadcast: `most` bounds them. A rule stays only if at least least_precision of the held-back
    third that it covers is bad.
    """
    sample = labelled_sample(labels, "quality", most)
    rows = cut(statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")), "quality-sample")
    grid = rows.agg(*[F.percentile_approx(f, [(i + 1) / bins for i in range(bins - 1)], 10_000).alias(f) for f in FEATURES]).first()
    steps = {f: sorted(set(grid[f] or [])) for f in FEATURES}
    cell = [sum((F.col(f) > t).cast("int") for t in steps[f]).alias(f) if steps[f] else F.lit(0).alias(f) for f in FEATURES]
    fold = (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0).alias("held")
    counts = rows.select(*cell, fold, (F.col("quality") == 0).alias("bad")).groupBy(*FEATURES, "held", "bad").count().collect()
    return _cover([(tuple(r[f] for f in FEATURES), r["held"], r["bad"], r["count"]) for r in counts], steps, least_precision, max_rules, max_conditions)


def _cover(cells: list, steps: dict, least_precision: float, max_rules: int, max_conditions: int) -> list[Rule]:
    """Sequential covering over counted cells of (bin numbers, held back, bad, count), for both classes in one list."""
    rules: list[Rule] = []

    def covers(rule: list, bins: tuple) -> bool:
        return all((bins[f] > i) == above for f, above, i in rule)

    def totals(rule: list, held: bool | None, keeps: bool) -> tuple[int, int]:
        """Rows that the rule covers: those of its class, and the others."""
        hit = [(bad != keeps, n) for bins, h, bad, n in cells if (held is None or h == held) and covers(rule, bins)]
        return sum(n for own, n in hit if own), sum(n for own, n in hit if not own)

    def grown(keeps: bool) -> list:
        rule: list = []
        own, other = totals(rule, False, keeps)
        while own and other and len(rule) < max_conditions:
            # Counts by feature and bin of what the rule covers; sums along the bins give every threshold at once.
            by = [{} for _ in FEATURES]
            for bins, held, bad, n in cells:
                if not held and covers(rule, bins):
                    for f, b in enumerate(bins):
                        by[f].setdefault(b, [0, 0])[bad == keeps] += n
            best = None
            for f, name in enumerate(FEATURES):
                p = n = 0
                for i in range(len(steps[name])):
                    p, n = p + by[f].get(i, (0, 0))[0], n + by[f].get(i, (0, 0))[1]
                    for above, (x, y) in ((False, (p, n)), (True, (own - p, other - n))):
                        if x:
                            gain = x * (math.log2(x / (x + y)) - math.log2(own / (own + other)))
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, (f, above, i), x, y)
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
            own, other = best[2], best[3]
        worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*totals(r, True, keeps))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        p, n = totals(rule, True, keeps)
        # A keeping rule must be surer: what it covers no later rule can reject.
        asked = least_precision if not keeps else 1 - (1 - least_precision) / 10
        return rule if rule and p >= 2 and p >= asked * (p + n) else []

    while len(rules) < max_rules:
        keeps = False
        if not (rule := grown(False)):
            keeps = True
            rule = grown(True) if totals([], None, False)[0] else []
        if not rule:
            break
        own, other = totals(rule, None, keeps)
        conditions = tuple(Condition(FEATURES[f], above, float(steps[FEATURES[f]][i])) for f, above, i in rule)
        rules.append(Rule(conditions, *((other, own) if keeps else (own, other)), keeps))
        cells = [c for c in cells if not covers(rule, c[0])]
    while rules and rules[-1].keeps:
        rules.pop()
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: what the first rule that fires says, else true."""
    out = None
    for rule in rules:
        test = rule.conditions[0].column()
        for c in rule.conditions[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(rule.keeps)) if out is None else out.when(test, F.lit(rule.keeps))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """statistics(docs) with base_failed and kept; empty and null texts fail the base rule."""
    return statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept_rows(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that apply_rules keeps.

    Rows and verdicts are written once: a filter straight above would be pushed below the statistics, which would then be
    computed again in each place that names them.
    """
    whole = docs.select(whole_row(docs), F.col(text_col).alias("_whole"))
    return cut(apply_rules(whole, rules, "_whole").select("_row", "kept"), "verdicts").where("kept").select("_row.*")
