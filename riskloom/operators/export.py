"""Findings as an exchange format: rule catalogue, results, tags, fingerprints, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import literal_map

# Level and score by severity, and weakness ids by zone.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SCORES = {"critical": "9.5", "high": "7.5", "medium": "5.5", "low": "2.5", "info": "1.0"}
CWES = {"auth": "CWE-287", "payment": "CWE-311", "crypto": "CWE-327", "database": "CWE-89", "pii": "CWE-359"}


def rule_name(rule_id: Column) -> Column:
    """PascalCase of a rule id."""
    parts = F.filter(F.split(rule_id, "[-._]"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def tags() -> Column:
    rule = F.coalesce("rule_id", F.lit(""))
    framework = F.when(rule.contains("CC"), "soc2").when(rule.contains("164"), "hipaa").when(F.replace(rule, F.lit(".")).rlike("^[0-9]+$"), "pci-dss")
    return F.array_compact(F.array(F.lit("riskloom"), F.concat(F.lit("sensitive-"), "zone"), literal_map(CWES)[F.col("zone")], framework))


def fingerprint() -> Column:
    text = F.concat_ws("|", F.coalesce("rule_id", F.lit("")), F.coalesce("file", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit("None")), F.substring(F.coalesce("message", F.lit("")), 1, 50))
    return F.substring(F.sha2(text, 256), 1, 32)


def rules(findings: DataFrame) -> DataFrame:
    """rule_id, name, text, level, score: from the first finding of each rule."""
    w = Window.partitionBy("rule_id").orderBy("change_id", "seq")
    first = findings.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.select("rule_id", rule_name(F.col("rule_id")).alias("name"), F.col("message").alias("text"), F.coalesce(literal_map(LEVELS)[F.col("severity")], F.lit("warning")).alias("level"), F.coalesce(literal_map(SCORES)[F.col("severity")], F.lit("5.5")).alias("score"))


def results(findings: DataFrame) -> DataFrame:
    """change_id, seq, rule_id, level, file, line, tags, fingerprint."""
    return findings.select("change_id", "seq", "rule_id", F.coalesce(literal_map(LEVELS)[F.col("severity")], F.lit("warning")).alias("level"), "file", "line", "message", tags().alias("tags"), fingerprint().alias("fingerprint"))


def documents(findings: DataFrame) -> DataFrame:
    """change_id, document: all results of a change as JSON, in discovery order."""
    row = F.struct("seq", F.struct("rule_id", "level", "file", "line", "message", "tags", "fingerprint").alias("r"))
    g = results(findings).groupBy("change_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("results"))
    return g.select("change_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct("results")).alias("runs"))).alias("document"))


def dedupe(findings: DataFrame) -> DataFrame:
    """fingerprint, n, first_change: equal findings across changes."""
    return results(findings).groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("change_id").alias("first_change"))
