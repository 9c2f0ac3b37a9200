"""Decisions from findings, the review gate, and the cards that report them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import POLICIES, DecisionPolicy
from riskloom.functions import literal_map, severity_rank


def map_findings(findings: DataFrame) -> DataFrame:
    """change_id, severity, category, location, description, provable, seq from classified findings."""
    has = lambda c: F.col(c) if c in findings.columns else F.lit(None).cast("string")
    place = F.when(F.col("file").isNotNull(), F.concat_ws(":", "file", F.col("line").cast("string")))
    text = F.concat(F.coalesce(F.concat(has("control_name"), F.lit(": ")), F.lit("")), F.col("message"))
    return findings.select("change_id", "severity", F.coalesce(has("control_category"), has("zone"), F.lit("general")).alias("category"), place.alias("location"), text.alias("description"), F.coalesce("provable", F.lit(False)).alias("provable"), "seq")


def rule_predicate(rules: tuple[dict, ...], field=F.col) -> Column:
    """Whether a finding has all that one of the rules asks for; field gives its severity, provable and category."""
    out = F.lit(False)
    for r in rules:
        test = F.lit(True)
        if "severity" in r:
            test = test & (field("severity") == r["severity"])
        if r.get("provable_only"):
            test = test & field("provable")
        if "category" in r:
            test = test & (field("category") == r["category"])
        out = out | test
    return out


def by_counts(blocks: Column, conditions: Column) -> Column:
    return F.when(blocks > 0, "block").when(conditions > 0, "merge-with-conditions").otherwise("merge")


def decide(changes: DataFrame, findings: DataFrame, policy: DecisionPolicy = POLICIES["standard"]) -> DataFrame:
    """change_id, decision, hard_blocks, conditions, advisory for every change; one without findings merges.

    Conditions are the worst first (in discovery order within a severity); those beyond max_conditions follow the
    advisories. One shuffle by change serves the ranking and the gathering.
    """
    kind = F.when(rule_predicate(policy.block), "block").when(rule_predicate(policy.conditions), "condition").otherwise("advisory")
    f = findings.withColumn("_kind", kind)
    order = Window.partitionBy("change_id", "_kind").orderBy(F.desc(severity_rank(F.col("severity"))), "seq")
    f = f.withColumn("_n", F.row_number().over(order)).withColumn("_over", (F.col("_kind") == "condition") & (F.col("_n") > policy.max_conditions))
    item = F.struct(F.col("severity"), F.col("category"), F.col("location"), F.col("description"), F.col("provable"))
    by_rank, by_seq = F.struct(F.col("_n").alias("k"), item.alias("x")), F.struct("_over", F.when(F.col("_over"), F.col("_n")).alias("k"), "seq", item.alias("x"))
    listed = lambda test, row: F.transform(F.array_sort(F.collect_list(F.when(test, row))), lambda r: r["x"])
    g = f.groupBy("change_id").agg(listed(F.col("_kind") == "block", F.struct("seq", item.alias("x"))).alias("hard_blocks"), listed((F.col("_kind") == "condition") & ~F.col("_over"), by_rank).alias("conditions"), listed((F.col("_kind") == "advisory") | F.col("_over"), by_seq).alias("advisory"))
    j = changes.select("change_id").join(g, "change_id", "left")
    decision = by_counts(F.size("hard_blocks"), F.size("conditions"))
    return j.select("change_id", decision.alias("decision"), "hard_blocks", "conditions", "advisory")


def gate(decisions: DataFrame, tiers: DataFrame, threshold: str = "L3") -> DataFrame:
    """Adds tier, requires_approval, effective_decision, n_conditions, reason and parse_error; a gated merge gets one more
    condition. A change without a tier is L2 with a parse_error."""
    error = F.col("parse_error") if "parse_error" in tiers.columns else F.lit(False)
    j = decisions.join(tiers.withColumn("parse_error", error), "change_id", "left")
    j = j.withColumns({"parse_error": F.col("tier").isNull() | F.coalesce("parse_error", F.lit(False)), "tier": F.coalesce("tier", F.lit("L2"))})
    return gated(j, F.greatest(F.size(F.coalesce("conditions", F.array())), F.lit(0)), threshold)


def gated(rows: DataFrame, n_conditions: Column, threshold: str = "L3") -> DataFrame:
    """Adds requires_approval, effective_decision, n_conditions and reason to rows with tier and decision."""
    asks = (F.col("tier") >= threshold) | (F.col("decision") != "merge")
    lifted = (F.col("tier") >= threshold) & (F.col("decision") == "merge")
    return rows.withColumns({"requires_approval": asks, "effective_decision": F.when(lifted, "merge-with-conditions").otherwise(F.col("decision")), "n_conditions": n_conditions + lifted.cast("int"), "reason": F.when(lifted, F.concat(F.lit("Risk tier "), "tier", F.lit(f" meets the approval threshold {threshold}")))})


def verdict(decision: Column) -> Column:
    return F.coalesce(literal_map({"merge": "APPROVE", "merge-with-conditions": "CONDITIONS", "block": "BLOCK"})[decision], F.lit("UNKNOWN"))


def run_status(decision: Column, fail_on_conditions: bool = False) -> Column:
    """failure for a block, and for conditions if they are to fail; success else. A decision that isn't known fails."""
    sound = ["merge"] if fail_on_conditions else ["merge", "merge-with-conditions"]
    return F.when(F.coalesce(decision.isin(*sound), F.lit(False)), "success").otherwise("failure")


def auto_merge(decision: Column, tier: Column, is_open: Column, conflict: Column) -> Column:
    return (decision == "merge") & (tier != "L4") & is_open & ~conflict


def cards(decisions: DataFrame) -> DataFrame:
    """change_id, card: the decision and its lists as text."""
    label = literal_map({"merge": "MERGE: safe to merge", "merge-with-conditions": "CONDITIONAL: reviewer action needed", "block": "BLOCKED: cannot merge"})
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- ["), x["severity"], F.lit("] "), F.concat_ws(" at ", x["description"], x["location"]))), "\n"))).otherwise("")
    return decisions.select("change_id", F.concat(label[F.col("decision")], part("Blocks", "hard_blocks"), part("Conditions", "conditions"), part("Advisory", "advisory")).alias("card"))


def latest_cards(rows: DataFrame) -> DataFrame:
    """change_id, ts, card -> the latest card of each change."""
    return rows.groupBy("change_id").agg(F.max("ts").alias("ts"), F.max_by("card", "ts").alias("card"))


# What a summary says of a message that holds the words on the left; the first that fits counts.
REWRITES = {
    "sensitive crypto code modified": "Security-relevant diff without traceable approval artifact",
    "sensitive auth code modified": "Auth logic changed without corresponding review evidence",
    "possible null dereference": "Runtime-impacting change lacks rollback signal",
    "potential auth bug": "Privilege-sensitive path modified; reviewer signoff missing",
    "sensitive security code modified": "Security-boundary change requires governance evidence",
    "sensitive config code modified": "Infrastructure config changed without policy review",
    "sensitive database code modified": "Data-layer change without migration evidence",
    "sensitive infra code modified": "Infrastructure change without deployment review",
}
LABELS = {"L0": "Trivial", "L1": "Low Risk", "L2": "Medium Risk", "L3": "High Risk", "L4": "Critical Risk"}


def reframed(message: Column) -> Column:
    out = message
    for words, said in reversed(REWRITES.items()):
        out = F.when(F.lower(message).contains(words), said).otherwise(out)
    return out


def summary_lines(findings: DataFrame) -> DataFrame:
    """change_id, no, line: the list of all findings of the changes that have more than three, in discovery order; a row for
    each finding, so that no change's list has to fit anywhere."""
    w = Window.partitionBy("change_id")
    f = findings.withColumns({"_all": F.count("*").over(w), "no": F.row_number().over(w.orderBy("seq"))}).where("_all > 3")
    return f.select("change_id", "no", F.concat(F.lit("- ["), "severity", F.lit("] "), _place(), F.lit(": "), reframed(F.col("message"))).alias("line"))


def _place() -> Column:
    return F.concat(F.lit("`"), F.concat_ws(":", F.coalesce("file", F.lit("unknown")), F.nullif(F.col("line"), F.lit(0)).cast("string")), F.lit("`"))


def summary_cards(gates: DataFrame, findings: DataFrame, drivers: DataFrame, threshold: str = "L3") -> DataFrame:
    """change_id, top, critical, high, other, drivers, evidence, policy, posture, gaps, card for every change of gates
    (change_id, tier, requires_approval: see gate).

    top holds the three worst findings in discovery order, with their place and reframed messages; summary_lines has the
    list of all. A change that needs approval, by its tier or by its decision, is blocked until someone gives it; else L2
    and L3 have conditions. gaps counts critical and high findings. Findings are ranked by a window, so only three of a
    change are ever gathered.
    """
    w = Window.partitionBy("change_id").orderBy(F.desc(severity_rank(F.col("severity"))), "seq")
    f = findings.withColumn("_n", F.row_number().over(w)).withColumn("_t", F.concat(F.col("_n").cast("string"), F.lit(". "), _place(), F.lit(": "), reframed(F.col("message"))))
    count = lambda s: F.count_if(F.col("severity") == s)
    g = f.groupBy("change_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= 3, F.struct("_n", "_t")))), lambda x: x["_t"]).alias("top"), count("critical").alias("critical"), count("high").alias("high"), F.count("*").alias("_all"))
    j = gates.select("change_id", "tier", "requires_approval").join(g, "change_id", "left").join(drivers.groupBy("change_id").agg(F.count("*").alias("drivers")), "change_id", "left")
    j = j.na.fill(0, ["critical", "high", "_all", "drivers"]).withColumns({"top": F.coalesce("top", F.array().cast("array<string>")), "other": F.col("_all") - F.col("critical") - F.col("high")})
    asks, middle = F.coalesce("requires_approval", F.lit(True)), F.col("tier").isin("L2", "L3")
    j = j.withColumns({"gaps": F.col("critical") + F.col("high"), "evidence": F.when(asks, "Review needed").otherwise("Complete"), "policy": F.when(F.col("tier").isin("L0", "L1"), "Compliant").when(middle, "Conditions").otherwise("Blocked"), "posture": F.when(asks, "Merge blocked").when(middle, "Merge with conditions").otherwise("Safe to merge")})
    head = F.concat("tier", F.lit(" ("), literal_map(LABELS)[F.col("tier")], F.lit(") | Evidence: "), "evidence", F.lit(" | Policy: "), "policy")
    tail = F.concat(F.lit("Findings: "), F.col("critical").cast("string"), F.lit(" critical, "), F.col("high").cast("string"), F.lit(" high, "), F.col("other").cast("string"), F.lit(" other; drivers: "), F.col("drivers").cast("string"))
    why = F.when(asks & (F.col("tier") >= threshold), F.concat(F.lit("Risk tier "), "tier", F.lit(f" meets the approval threshold {threshold}"))).when(asks, "The decision asks for approval")
    return j.withColumn("card", F.concat_ws("\n", head, F.when(F.size("top") > 0, F.array_join("top", "\n")), F.when(F.size("top") == 3, F.when(F.col("_all") > 3, F.concat(F.lit("of "), F.col("_all").cast("string"), F.lit(" findings")))), tail, "posture", why)).drop("_all", "tier", "requires_approval")
