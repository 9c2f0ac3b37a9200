"""Tiers, findings and drivers of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import EARLY_PATHS, RiskPolicy
from riskloom.functions import any_match, downgrade, literal_map, severity, severity_rank
from riskloom.operators.lines import fallback_totals, is_test

DEFAULT = RiskPolicy()


def path_score(path: Column, policy: RiskPolicy = DEFAULT) -> Column:
    """4, 3, 1 or 0 by the first tier, in that order, with a pattern in the path; else 2."""
    out = None
    for tier, score in (("L4", 4), ("L3", 3), ("L1", 1), ("L0", 0)):
        test = any_match(path, policy.paths[tier])
        out = F.when(test, score) if out is None else out.when(test, score)
    return out.otherwise(2)


def size_score(total: Column, policy: RiskPolicy = DEFAULT) -> Column:
    return F.when(total > policy.sizes["large"], 3).when(total > policy.sizes["medium"], 2).when(total > policy.sizes["small"], 1).otherwise(0)


def zone_rank(zone: Column, policy: RiskPolicy = DEFAULT) -> Column:
    """The rank of a zone's severity; an unknown zone is medium."""
    return severity_rank(F.coalesce(literal_map(policy.zone_severity)[zone], F.lit("medium")))


def preliminary_tier(files: DataFrame, hits: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """change_id, preliminary_tier: from flags by change, so the order of files doesn't matter. With changes, those of
    which no file was parsed are L2."""
    p = F.col("path")
    flag = lambda t: F.bool_or(any_match(p, EARLY_PATHS[t]))
    f = files.groupBy("change_id").agg(flag("L4").alias("l4"), flag("L3").alias("l3"), flag("L1").alias("l1"), F.bool_or(~any_match(p, EARLY_PATHS["L0"])).alias("real"), F.sum(F.col("added") + F.col("removed")).alias("total"))
    has = lambda *z: F.bool_or(F.col("zone").isin(*z))
    z = hits.groupBy("change_id").agg(has("payment", "crypto", "pii").alias("z4"), has("auth", "security").alias("z3"), has("database", "config", "infra").alias("z2"))
    j = f.join(z, "change_id", "left")
    base = F.when(F.col("l4"), 4).when(F.col("l3"), 3).when(F.col("l1"), 1).otherwise(0)
    zone = F.when(F.col("z4"), 4).when(F.col("z3"), 3).when(F.col("z2"), 2).otherwise(0)
    size = F.when(F.col("total") > 500, 3).when(F.col("total") > 100, 2).otherwise(0)
    score = F.greatest(base, zone, size)
    out = j.select("change_id", F.concat(F.lit("L"), F.when((score == 0) & F.col("real"), 2).otherwise(score).cast("string")).alias("preliminary_tier"))
    return out if changes is None else changes.select("change_id").join(out, "change_id", "left").select("change_id", F.coalesce("preliminary_tier", F.lit("L2")).alias("preliminary_tier"))


def floors(files: DataFrame, hits: DataFrame, policy: RiskPolicy = DEFAULT, changes: DataFrame | None = None) -> DataFrame:
    """change_id, file_score, zone_score, size_score, floor, protected: the deterministic part of the final tier.

    With changes (change_id, diff, or their fallback_totals) every change has a row, and parse_error tells those of which no
    file or not every hunk was parsed: what was parsed counts, the size is at least that of the marks alone, and the floor is
    2 at least.
    """
    if changes is not None:
        return _all_floors(files, hits, policy, changes)
    f = files.groupBy("change_id").agg(F.max(path_score(F.col("path"), policy)).alias("file_score"), size_score(F.sum(F.col("added") + F.col("removed")), policy).alias("size_score"))
    z = hits.groupBy("change_id").agg(F.max(zone_rank(F.col("zone"), policy)).alias("zone_score"))
    j = f.join(z, "change_id", "left").withColumn("zone_score", F.coalesce("zone_score", F.lit(0)))
    j = j.withColumn("floor", F.greatest("file_score", "zone_score", "size_score"))
    return j.select("change_id", "file_score", "zone_score", "size_score", "floor", (F.col("floor") >= 3).alias("protected"))


def _all_floors(files: DataFrame, hits: DataFrame, policy: RiskPolicy, changes: DataFrame) -> DataFrame:
    f = files.groupBy("change_id").agg(F.max(path_score(F.col("path"), policy)).alias("file_score"), F.sum(F.col("added") + F.col("removed")).alias("_total"), F.bool_or("broken").alias("_broken"))
    z = hits.groupBy("change_id").agg(F.max(zone_rank(F.col("zone"), policy)).alias("zone_score"))
    totals = fallback_totals(changes) if "diff" in changes.columns else changes
    marks = totals.select("change_id", F.greatest(F.col("lines_added") + F.col("lines_removed"), F.lit(0)).alias("_marks"))
    j = marks.join(f, "change_id", "left").join(z, "change_id", "left").withColumn("parse_error", F.coalesce("_broken", F.lit(True)))
    total = F.when(F.col("parse_error"), F.greatest(F.coalesce("_total", F.lit(0)), F.coalesce("_marks", F.lit(0)))).otherwise(F.col("_total"))
    j = j.withColumns({"file_score": F.coalesce("file_score", F.lit(2)), "zone_score": F.coalesce("zone_score", F.lit(0)), "size_score": size_score(total, policy)})
    j = j.withColumn("floor", F.greatest("file_score", "zone_score", "size_score", F.when(F.col("parse_error"), 2).otherwise(0)))
    return j.select("change_id", "file_score", "zone_score", "size_score", "floor", (F.col("floor") >= 3).alias("protected"), "parse_error")


def zone_findings(hits: DataFrame, secrets: DataFrame | None = None, policy: RiskPolicy = DEFAULT) -> DataFrame:
    """change_id, file, line, zone, rule_id, severity, provable, message, seq: one for each zone, file and line.

    Of several the first in discovery order stays (zones of a file before its secrets, secrets of a line in the order of rules). In test files zones are info,
    and secrets are high and not provable. Only secrets may be provable.
    """
    # A line without a path is in no test.
    test = F.coalesce(is_test(F.col("file")), F.lit(False))
    z = hits.select("change_id", "file_no", "file", "line", "ord", "zone", F.struct(F.lit(0).alias("source"), F.col("file_no"), F.col("ord"), F.col("zone_no").alias("no")).alias("seq"), F.concat(F.lit("sensitive-"), "zone").alias("rule_id"), F.when(test, "info").otherwise(F.coalesce(literal_map(policy.zone_severity)[F.col("zone")], F.lit("medium"))).alias("severity"), F.lit(False).alias("provable"), F.concat(F.lit("Sensitive "), "zone", F.lit(" code modified")).alias("message"))
    if secrets is not None:
        s = secrets.select("change_id", "file_no", "file", "line", "ord", "zone", F.struct(F.lit(1).alias("source"), F.col("file_no"), F.col("ord"), F.col("kind_no").alias("no")).alias("seq"), F.concat(F.lit("secret-"), "kind").alias("rule_id"), F.when(test, "high").otherwise(severity(F.col("severity"))).alias("severity"), (~test & F.col("provable")).alias("provable"), F.concat(F.lit("Hardcoded secret detected ("), "kind", F.lit(")")).alias("message"))
        z = z.unionByName(s)
    w = Window.partitionBy("change_id", "zone", "file", "line").orderBy("seq")
    return z.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("change_id", "file", "line", "zone", "rule_id", "severity", "provable", "message", "seq")


def modulate(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings after the reviewers' consensus (change_id, consensus_risk, agreement_score, protected).

    approve from 0.6 on lowers zone findings of unprotected changes twice, criticals to high at the lowest; comment lowers
    them once, at any agreement; request_changes from 0.6 on lifts every medium finding to high. Findings without a zone and
    those of rubric rules (rule_id RUBRIC...) are never lowered.
    """
    j = findings.join(verdicts, "change_id", "left")
    rubric = F.coalesce(F.col("rule_id").startswith("RUBRIC"), F.lit(False))
    open_ = F.col("zone").isNotNull() & (F.col("zone") != "") & ~rubric & ~F.coalesce("protected", F.lit(False))
    sure = F.coalesce(F.col("agreement_score") >= 0.6, F.lit(False))
    s = F.col("severity")
    twice = F.when(s == "critical", "high").otherwise(downgrade(downgrade(s)))
    out = F.when((F.col("consensus_risk") == "approve") & sure & open_, twice).when((F.col("consensus_risk") == "comment") & open_, downgrade(s)).when((F.col("consensus_risk") == "request_changes") & sure & (s == "medium"), "high").otherwise(s)
    return j.withColumn("severity", out).select(*findings.columns)


def concern_findings(verdicts: DataFrame) -> DataFrame:
    """change_id, id, rule_id, severity, provable, message, no: the first three combined concerns of a change as findings
    without a file; high where a majority asks for changes, else medium; never provable."""
    sure = F.coalesce(F.col("agreement_score") >= 0.6, F.lit(False))
    asks = F.col("consensus_risk") == "request_changes"
    kind = F.when(asks & sure, "AI-CONCERN").when(asks, "AI-MINORITY").when(F.col("consensus_risk") == "comment", "AI-COMMENT")
    e = verdicts.withColumn("_kind", kind).where("_kind is not null").select("*", F.posexplode(F.slice("combined_concerns", 1, 3)).alias("no", "concern"))
    lead = F.when(F.col("_kind") == "AI-MINORITY", "AI minority concern: ").otherwise("AI concern: ")
    return e.select("change_id", F.concat_ws("-", "_kind", F.col("no").cast("string")).alias("id"), F.lit("ai-consensus").alias("rule_id"), F.when(F.col("_kind") == "AI-CONCERN", "high").otherwise("medium").alias("severity"), F.lit(False).alias("provable"), F.concat(lead, "concern").alias("message"), "no")


def final_tier(floor_rows: DataFrame, findings: DataFrame) -> DataFrame:
    """change_id, tier (and parse_error, if the floors have it): the floor, at least 4 with a critical finding and 3 with
    a high one."""
    worst = findings.groupBy("change_id").agg(F.max(severity_rank(F.col("severity"))).alias("worst"))
    lift = F.when(F.col("worst") == 4, 4).when(F.col("worst") == 3, 3).otherwise(0)
    return floor_rows.join(worst, "change_id", "left").select("change_id", F.concat(F.lit("L"), F.greatest("floor", lift).cast("string")).alias("tier"), *[c for c in floor_rows.columns if c == "parse_error"])


def zone_drivers(hits: DataFrame, top: int = 3) -> DataFrame:
    """change_id, rank, zone, hits, description: the zones with most hits and their first three places.

    Hits are summed by place first, so the largest change sends no more than its places, and no array holds them.
    """
    places = hits.groupBy("change_id", "zone", "file", "line").agg(F.count("*").alias("n"), F.min(F.struct("file_no", "ord", "zone_no")).alias("_first"))
    nth = Window.partitionBy("change_id", "zone").orderBy("_first")
    p = places.withColumn("_nth", F.row_number().over(nth))
    ref = F.when(F.col("_nth") <= 3, F.struct("_nth", F.concat(F.lit("`"), F.concat_ws(":", "file", F.col("line").cast("string")), F.lit("`")).alias("t")))
    g = p.groupBy("change_id", "zone").agg(F.sum("n").alias("hits"), F.count("*").alias("_places"), F.min("_first").alias("_first"), F.array_sort(F.collect_list(ref)).alias("_refs"))
    w = Window.partitionBy("change_id").orderBy(F.desc("hits"), "_first")
    more = F.when(F.col("_places") > 3, F.concat(F.lit(" +"), (F.col("_places") - 3).cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat(F.col("hits").cast("string"), F.lit(" changes in "), "zone", F.lit(" code ("), F.array_join(F.transform("_refs", lambda x: x["t"]), ", "), more, F.lit(")"))
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("change_id", "rank", "zone", "hits", text.alias("description"))


def finding_drivers(findings: DataFrame, top: int = 3) -> DataFrame:
    """change_id, rank, severity, description: the worst findings, in discovery order within a severity; the place, if
    there is one, in backquotes."""
    w = Window.partitionBy("change_id").orderBy(F.desc(severity_rank(F.col("severity"))), "seq")
    place = F.when(F.coalesce("file", F.lit("")) != "", F.concat(F.lit(" (`"), F.concat_ws(":", "file", F.nullif(F.col("line"), F.lit(0)).cast("string")), F.lit("`)"))).otherwise("")
    return findings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("change_id", "rank", "severity", F.concat("message", place).alias("description"))


def path_drivers(files: DataFrame, policy: RiskPolicy = DEFAULT, top: int = 3) -> DataFrame:
    """change_id, rank, description: the files with the highest path scores, in the order of files, where any scores above 0."""
    f = files.where("path <> ''").withColumn("_score", path_score(F.col("path"), policy)).withColumn("_most", F.max("_score").over(Window.partitionBy("change_id")))
    w = Window.partitionBy("change_id").orderBy(F.desc("_score"), "file_no")
    text = F.concat(F.lit("File path `"), "path", F.lit("` contributed L"), F.col("_score").cast("string"), F.lit(" risk scoring"))
    return f.where("_most > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("change_id", "rank", text.alias("description"))


def risk_drivers(zones: DataFrame, found: DataFrame, concerns: DataFrame, files: DataFrame, policy: RiskPolicy = DEFAULT, top: int = 5) -> DataFrame:
    """change_id, rank, type, description: at most `top` of a change's drivers: of zones, of findings, and the reviewers'
    first two concerns (change_id, concerns); drivers of paths only where there is no other."""
    part = lambda df, no, kind: df.select("change_id", F.lit(no).alias("_no"), F.col("rank").alias("_rank"), F.lit(kind).alias("type"), "description")
    voiced = concerns.select("change_id", F.posexplode(F.slice("concerns", 1, 2)).alias("rank", "description"))
    each = part(zone_drivers(zones), 0, "sensitive_zone").unionByName(part(finding_drivers(found), 1, "policy_finding")).unionByName(part(voiced, 2, "ai_concern")).unionByName(part(path_drivers(files, policy), 3, "file_pattern"))
    whole = Window.partitionBy("change_id")
    each = each.withColumn("_other", F.min("_no").over(whole) < 3).where("_no < 3 or not _other")
    return each.withColumn("rank", F.row_number().over(whole.orderBy("_no", "_rank"))).where(F.col("rank") <= top).select("change_id", "rank", "type", "description")


# The sentences that explain a tier.
RATIONALES = {
    "L0": "Trivial change (documentation, formatting, or configuration only)",
    "L1": "Low-risk change (tests or non-critical code)",
    "L2": "Medium-risk change (feature code, review recommended)",
    "L3": "High-risk change: {}. Human approval required.",
    "L4": "Critical risk: {}. Executive approval may be required.",
}
RATIONALE_DEFAULTS = ("sensitive code detected", "Critical risk: security, payment, or PII code affected. Executive approval required.")


def rationale(tiers: DataFrame, drivers: DataFrame, findings: DataFrame) -> DataFrame:
    """change_id, tier, rationale: one sentence for the tier; at L3 with the first driver, at L4 with the first critical finding."""
    top = drivers.where("rank = 1").select("change_id", F.col("description").alias("_driver"))
    worst = findings.where("severity = 'critical'").groupBy("change_id").agg(F.min_by("message", "seq").alias("_critical"))
    j = tiers.join(top, "change_id", "left").join(worst, "change_id", "left")
    filled = lambda tier, value: F.concat(F.lit(RATIONALES[tier].split("{}")[0]), value, F.lit(RATIONALES[tier].split("{}")[1]))
    high = filled("L3", F.coalesce("_driver", F.lit(RATIONALE_DEFAULTS[0])))
    critical = F.coalesce(filled("L4", F.col("_critical")), F.lit(RATIONALE_DEFAULTS[1]))
    text = F.when(F.col("tier") == "L3", high).when(F.col("tier") == "L4", critical).otherwise(literal_map({k: RATIONALES[k] for k in ("L0", "L1", "L2")})[F.col("tier")])
    return j.select("change_id", "tier", text.alias("rationale"))
