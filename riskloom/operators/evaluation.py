"""Quality of decisions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_results(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """change_id, decision, consensus_risk, tier and change_id, expected_flag, category, dataset -> one scored row each.

    Only vulnerable and clean rows count (scored): counts and rates are over these.
    """
    j = labels.join(decisions, "change_id")
    flagged = F.col("decision").isin("block", "merge-with-conditions")
    ai = F.coalesce(F.col("consensus_risk").isin("comment", "request_changes"), F.lit(False))
    return j.select("change_id", "dataset", "category", "expected_flag", "tier", flagged.alias("flagged"), ai.alias("ai_detected"), (flagged == F.col("expected_flag")).alias("correct"), (flagged & ~F.col("expected_flag")).alias("false_positive"), (~flagged & F.col("expected_flag")).alias("false_negative")).withColumn("scored", F.col("category").isin("vulnerable", "clean"))


def _pct(n: Column, of: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(n * 100.0, of), 1), F.lit(0.0))


def _stats(threshold_fp: float, threshold_fn: float) -> list[Column]:
    s, bad = F.col("scored"), F.col("expected_flag")
    n = lambda c: F.count_if(s & c)
    vuln, clean = n(bad), n(~bad)
    fp, fn = n(F.col("false_positive")), n(F.col("false_negative"))
    return [
        n(F.lit(True)).alias("total"), F.count_if(~s).alias("excluded"), vuln.alias("vuln_count"), clean.alias("clean_count"), n(F.col("correct")).alias("correct"),
        _pct(n(F.col("correct")), n(F.lit(True))).alias("accuracy_pct"), _pct(n(bad & F.col("flagged")), vuln).alias("detect_rate_pct"), fp.alias("fp"), _pct(fp, clean).alias("fp_rate_pct"), fn.alias("fn"), _pct(fn, vuln).alias("fn_rate_pct"),
        (F.coalesce(F.try_divide(fp * 100.0, clean), F.lit(0.0)) < threshold_fp).alias("fp_pass"), (F.coalesce(F.try_divide(fn * 100.0, vuln), F.lit(0.0)) < threshold_fn).alias("fn_pass"),
        _pct(n(bad & F.col("ai_detected")), vuln).alias("ai_detect_pct"), _pct(n(~bad & F.col("ai_detected")), clean).alias("ai_fp_pct"),
    ]


def stats(results: DataFrame, threshold_fp: float = 5.0, threshold_fn: float = 5.0) -> DataFrame:
    return results.agg(*_stats(threshold_fp, threshold_fn))


def rollup(results: DataFrame, threshold_fp: float = 5.0, threshold_fn: float = 5.0) -> DataFrame:
    """The same for all rows (level 3), by dataset (1) and by dataset and category (0)."""
    return results.rollup("dataset", "category").agg(F.grouping_id().cast("int").alias("level"), *_stats(threshold_fp, threshold_fn))


def tier_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("category").pivot("tier", ["L0", "L1", "L2", "L3", "L4"]).count().na.fill(0)


def failures(results: DataFrame) -> DataFrame:
    kind = F.when(F.col("false_positive"), "FP").when(F.col("false_negative"), "FN")
    return results.where("scored and (false_positive or false_negative)").select("change_id", "dataset", "category", kind.alias("kind"), "tier")


def detected(expected: Column, found: Column, flag: Column, level: Column, text: Column) -> Column:
    """A case counts as detected by its flag, a level from 1 on, a shared signal, or a signal named in its text."""
    named = F.exists(expected, lambda s: F.lower(text).contains(F.lower(s)))
    return flag | (level >= 1) | F.arrays_overlap(expected, found) | F.coalesce(named, F.lit(False))


def class_match(expected: Column, found: Column) -> Column:
    """Equal at level 4, within one elsewhere."""
    return F.when(expected == 4, found == 4).otherwise(F.abs(expected - found) <= 1)


def confusion(results: DataFrame) -> DataFrame:
    """expected, found (levels) -> a 5 x 5 matrix by row."""
    return results.groupBy("expected").pivot("found", [0, 1, 2, 3, 4]).count().na.fill(0)


def level_rates(results: DataFrame) -> DataFrame:
    """expected, found, detected -> fn_rate: the share of cases from level 2 on that weren't detected; fp_rate: the share of
    level 0 that were; in one row."""
    real, none = F.col("expected") >= 2, F.col("expected") == 0
    rate = lambda n, of: F.coalesce(F.try_divide(F.count_if(n), F.count_if(of)), F.lit(0.0))
    return results.agg(rate(real & ~F.col("detected"), real).alias("fn_rate"), rate(none & F.col("detected"), none).alias("fp_rate"))


def council_scores(cases: DataFrame, named: DataFrame, findings: DataFrame) -> DataFrame:
    """case_id, consensus_correct, total_findings, actionable_findings, actionability for every case.

    cases: case_id, expected, found (levels); named: case_id, finding_id of the consensus; findings: case_id, id,
    remediation, file_paths. A finding that no row describes isn't counted; one with a remediation and a path is actionable.
    """
    acts = (F.coalesce("remediation", F.lit("")) != "") & (F.coalesce(F.size("file_paths"), F.lit(0)) > 0)
    own = findings.select("case_id", F.col("id").alias("finding_id"), acts.alias("_acts"))
    g = named.join(own, ["case_id", "finding_id"]).groupBy("case_id").agg(F.count("*").alias("total_findings"), F.count_if(F.col("_acts")).alias("actionable_findings"))
    j = cases.join(g, "case_id", "left").na.fill(0, ["total_findings", "actionable_findings"])
    share = F.coalesce(F.try_divide("actionable_findings", "total_findings"), F.lit(0.0))
    return j.select("case_id", class_match(F.col("expected"), F.col("found")).alias("consensus_correct"), "total_findings", "actionable_findings", share.alias("actionability"))


#: What a stored output holds where a field is missing, as JSON by type, and the same for its council.
OUTPUT_DEFAULTS = {"detected": ("boolean", "false"), "risk_level": ("int", "0"), "signals": ("array<string>", "[]"), "categories": ("array<string>", "[]"), "findings": ("array<string>", "[]")}
COUNCIL_DEFAULTS = {"enabled": ("boolean", "false"), "models": ("array<string>", "[]"), "naive": ("map<string,string>", "{}"), "round_robin": ("map<string,string>", "{}"), "consensus": ("map<string,string>", '{"findings":"[]","human_required":"false","risk_level":"0","signals":"[]"}')}


def apply_defaults(outputs: DataFrame, column: str = "output") -> DataFrame:
    """outputs with the fields of a JSON column, defaults for those that are missing, and warnings that name them in order."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    inner = F.coalesce(F.json_object_keys(F.get_json_object(column, "$.council")), F.array().cast("array<string>"))
    types = ", ".join(f"{k} {t}" for k, (t, _) in OUTPUT_DEFAULTS.items()) + ", council struct<" + ", ".join(f"{k}: {t}" for k, (t, _) in COUNCIL_DEFAULTS.items()) + ">"
    parsed = F.from_json(column, types)
    value = lambda at, k, t, d: F.coalesce(at[k], F.from_json(F.lit('{"x":' + d + "}"), f"x {t}")["x"]).alias(k)
    told = [F.when(~F.array_contains(keys, k), F.lit(f"Missing field '{k}', using default")) for k in (*OUTPUT_DEFAULTS, "council")]
    # An output without any council gets a whole one, and its fields aren't told of again.
    told += [F.when(F.array_contains(keys, "council") & ~F.array_contains(inner, k), F.lit(f"Missing council.{k}, using default")) for k in COUNCIL_DEFAULTS]
    fields = [value(F.col("_parsed"), k, t, d) for k, (t, d) in OUTPUT_DEFAULTS.items()]
    council = F.struct(*[value(F.col("_parsed.council"), k, t, d) for k, (t, d) in COUNCIL_DEFAULTS.items()]).alias("council")
    return outputs.withColumn("_parsed", parsed).select(*outputs.columns, *fields, council, F.array_compact(F.array(*told)).alias("warnings"))


def hit_rate(votes: DataFrame) -> DataFrame:
    """case_id, voter, signals, expected -> case_id, hit_rate: the share of voters with an expected signal."""
    return votes.groupBy("case_id").agg(F.avg(F.arrays_overlap("signals", "expected").cast("double")).alias("hit_rate"))


def round_deltas(votes: DataFrame) -> DataFrame:
    """case_id, voter, round, level, added, rejected -> the change of level from round 1 to 2, else added less rejected."""
    a, b = votes.where("round = 1"), votes.where("round = 2")
    j = a.select("case_id", "voter", F.col("level").alias("l1")).join(b.select("case_id", "voter", F.col("level").alias("l2"), "added", "rejected"), ["case_id", "voter"])
    return j.select("case_id", "voter", F.when(F.col("l1") != F.col("l2"), F.col("l2") - F.col("l1")).otherwise(F.col("added") - F.col("rejected")).alias("delta"))


def voter_report(deltas: DataFrame) -> DataFrame:
    d = F.col("delta")
    return deltas.groupBy("voter").agg(F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count_if(d == 0).alias("same"), F.avg(d).alias("mean_delta"))
