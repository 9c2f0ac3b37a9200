"""The whole assessment of a change in its row: parse, scan, score, decide and gate.

Every step is an expression over the change's own arrays of lines and files, so there is no shuffle, no window and no join:
the same plan serves a batch and a stream, and a change is never gathered from elsewhere. It gives the rows that the tables
of the other modules give (diff_lines, zone_hits, floors, findings, decide, gate), where they are wanted by change only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import POLICIES, SEVERITIES, ZONES, DecisionPolicy
from riskloom.functions import let
from riskloom.operators import decision, lines, scans, scoring


def _rank(severity: str) -> int:
    return SEVERITIES.index(severity if severity in SEVERITIES else "critical")


def line_findings(line: Column, zones: dict[str, str], secrets, policy: scoring.RiskPolicy) -> Column:
    """The zones and the first secret of an added line: structs of source (0 zone, 1 secret), file_no, ord, no, zone, file,
    line, zone_rank (null for secrets), severity and provable."""
    path, content = line["path"], line["content"]

    def struct(test: Column, source: int, no: int, zone: str, rank: int | None, severity: Column, provable: Column) -> Column:
        own = F.struct(F.lit(source).alias("source"), line["file_no"].alias("file_no"), line["ord"].alias("ord"), F.lit(no).alias("no"), F.lit(zone).alias("zone"), path.alias("file"), line["line_number"].alias("line"), F.lit(rank).cast("int").alias("zone_rank"), severity.alias("severity"), provable.alias("provable"))
        return F.when(test, own)

    def found(facts: Column) -> Column:
        test = facts["test"]
        out = []
        for i, (name, pattern) in enumerate(scans.found_zones(facts["topic"], facts["raw"], zones, facts["low_topic"], facts["low_raw"]).items()):
            severity = policy.zone_severity.get(name, "medium")
            out.append(struct(pattern & ~facts["doc"], 0, i, name, _rank(severity), F.when(test, "info").otherwise(severity), F.lit(False)))
        kinds = [struct(content.rlike(p), 1, i, "entropy_secret", None, F.when(test, "high").otherwise(SEVERITIES[_rank(s)]), ~test & F.lit(v)) for i, (_, p, s, v) in enumerate(secrets)]
        hidden = F.when(~scans.matches(content, facts["low_raw"], scans.HASH_FIELD, scans.EXACT), F.coalesce(*kinds)) if kinds else F.lit(None)
        return F.array_compact(F.array(*out, hidden))

    facts = F.struct(F.coalesce(lines.is_test(path), F.lit(False)).alias("test"), F.coalesce(lines.is_doc(path), F.lit(True)).alias("doc"), F.concat(lines.topic_text(path, content), F.lit("\n")).alias("topic"), F.concat(content, F.lit("\n")).alias("raw"))
    # The plain texts by themselves first, so that each is made once.
    names = ("test", "doc", "topic", "raw")
    return let(facts, lambda f: let(F.struct(*[f[n].alias(n) for n in names], scans.plain(f["topic"]).alias("low_topic"), scans.plain(f["raw"]).alias("low_raw")), found))


def findings(body: Column, zones: dict[str, str], secrets, policy: scoring.RiskPolicy) -> Column:
    """Of the lines of a change, the first finding of each zone, file and line in discovery order, and in that order all
    zone ranks: struct of findings and zone_rank (the highest, 0 without one)."""
    every = F.flatten(F.transform(F.filter(body, lambda x: x["type"] == "add"), lambda x: line_findings(x, zones, secrets, policy)))
    keyed = lambda hits: F.array_sort(F.transform(hits, lambda h: F.struct(h["zone"].alias("zone"), h["file"].alias("file"), h["line"].alias("line"), h["source"].alias("source"), h["file_no"].alias("file_no"), h["ord"].alias("ord"), h["no"].alias("no"), h["severity"].alias("severity"), h["provable"].alias("provable"))))
    before = lambda rows, i: F.get(rows, F.greatest(i - 1, F.lit(0)))
    firsts = lambda rows: F.filter(rows, lambda x, i: (i == 0) | ~(x["zone"].eqNullSafe(before(rows, i)["zone"]) & x["file"].eqNullSafe(before(rows, i)["file"]) & x["line"].eqNullSafe(before(rows, i)["line"])))
    return let(every, lambda hits: F.struct(let(keyed(hits), firsts).alias("found"), F.coalesce(F.array_max(F.transform(hits, lambda h: h["zone_rank"])), F.lit(0)).alias("zone_rank")))


def assess(changes: DataFrame, zones: dict[str, str] = ZONES, secrets=scans.SECRETS, policy: scoring.RiskPolicy = scoring.DEFAULT, decisions: DecisionPolicy = POLICIES["standard"], threshold: str = "L3") -> DataFrame:
    """change_id, diff -> change_id, tier, decision, effective_decision, requires_approval, n_conditions, parse_error for
    every row of changes. A null diff doesn't parse."""
    total = lambda files: F.aggregate(files, F.lit(0).cast("long"), lambda a, f: a + f["added"] + f["removed"])
    none = lambda kind: F.array().cast(f"array<{kind}>")
    each = changes.select("change_id", F.col("diff").alias("_diff"), lines.parsed(F.col("diff")).alias("_p"))
    each = each.select("change_id", "_diff", F.coalesce("_p.files", none(lines.FILE)).alias("_files"), findings(F.coalesce("_p.lines", none(lines.LINE)), zones, secrets, policy).alias("_f"))
    each = each.select(
        "change_id", F.coalesce(F.array_max(F.transform("_files", lambda f: scoring.path_score(f["path"], policy))), F.lit(2)).alias("file_score"), F.col("_f.zone_rank").alias("zone_score"), total(F.col("_files")).alias("_total"),
        ((F.size("_files") == 0) | F.exists("_files", lambda f: f["broken"])).alias("parse_error"), lines.marks(F.col("_diff")).alias("_marks"),
        F.coalesce(F.array_max(F.transform("_f.found", lambda f: F.array_position(F.array(*map(F.lit, SEVERITIES)), f["severity"]).cast("int") - 1)), F.lit(0)).alias("_worst"),
        _count("_f.found", decisions.block).alias("_blocks"), _count("_f.found", decisions.conditions, decisions.block).alias("_conditions"),
    )
    size = scoring.size_score(F.when(F.col("parse_error"), F.greatest("_total", F.coalesce("_marks.lines_added", F.lit(0)) + F.coalesce("_marks.lines_removed", F.lit(0)))).otherwise(F.col("_total")), policy)
    floor = F.greatest("file_score", "zone_score", size, F.when(F.col("parse_error"), 2).otherwise(0), F.when(F.col("_worst") >= 3, F.col("_worst")).otherwise(0))
    each = each.select("change_id", "parse_error", F.concat(F.lit("L"), floor.cast("string")).alias("tier"), decision.by_counts(F.col("_blocks"), F.col("_conditions")).alias("decision"), F.least("_conditions", F.lit(decisions.max_conditions)).alias("_n"))
    return decision.gated(each, F.col("_n"), threshold).select("change_id", "tier", "decision", "effective_decision", "requires_approval", "n_conditions", "parse_error")


def _count(found: str, rules: tuple[dict, ...], but: tuple[dict, ...] = ()) -> Column:
    """How many findings one of the rules fits, and none of the others; a finding's category is its zone."""
    names = {"severity": "severity", "provable": "provable", "category": "zone"}
    test = lambda f, r: decision.rule_predicate(r, lambda c: f[names[c]])
    return F.size(F.filter(found, lambda f: test(f, rules) & ~test(f, but)))
