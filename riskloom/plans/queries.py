"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import functions as fn
from riskloom.operators import decision, evaluation, evidence, export, lines, origins, packs, scans, scoring, votes
from riskloom.plans import inputs
from riskloom.plans.inputs import table
from riskloom.sources import cut, infer_path, load_rubric, stable_name
from riskloom.streaming import assess, window_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

RUBRIC = [
    {"id": "R-LICENCE", "severity": "medium", "message": "Licence text changed", "patterns": ["licensed under"], "exceptions": ["docs/*"]},
    {"id": "R-TOKEN", "severity": "high", "message": "Token assigned", "patterns": ["token = "], "exceptions": []},
    {"id": "R-MARK", "severity": "odd", "message": "Marks repeated", "patterns": [r"\$\$\$", "!!"], "exceptions": ["conf/*", "docs/*"]},
    {"id": "R-WEB", "severity": "low", "message": "Web code changed", "patterns": [r"^web/"], "exceptions": []},
]
RAW_RUBRIC = {
    "rules": {
        "R-TOKEN": {"pattern": "token = ", "severity": "HIGH", "description": "Token assigned"},
        "R-MARK": {"patterns": ["(bad", r"\$\$\$", "!!"], "severity": "odd", "exceptions": "docs/*"},
        "R-PLAIN": "licensed under",
        "R-NONE": {"message": "no pattern"},
        "R-BAD": {"pattern": "(bad"},
    }
}
PACK = [
    {"trigger": "licence", "category": "legal", "level": 2, "keywords": ["licensed", "license"]},
    {"trigger": "insult", "category": "conduct", "level": 3, "keywords": ["idiot", "moron", "scum"]},
    {"trigger": "address", "category": "privacy", "level": 4, "pattern": "[a-z0-9.]+@[a-z0-9]+[.][a-z]+"},
]
THEMES = {"legal": ["LIC-1"], "conduct": ["HR-1", "HR-2"], "privacy": ["PRIV-1", "PRIV-2"]}
BANDS = [(0, 19.99, "minimal"), (20, 39.99, "low"), (40, 59.99, "moderate"), (60, 79.99, "high"), (80, 100, "severe")]
SALT = "riskloom-salt"


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def a2_assemble_diffs(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("change_id"), F.col("turn").alias("ord"), F.concat(F.col("role"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("patch"))
    return lines.assemble_diffs(c).select("change_id", F.md5("diff").alias("diff_md5"))


@query
def a6_code_to_patch(spark, d):
    return inputs.changes(spark, d).select("change_id", F.md5("diff").alias("diff_md5"))


@query
def a7_inferred_paths(spark, d):
    lang = F.get(F.array(*map(F.lit, ("javascript", "python", "typescript", "rust", "cobol"))), (F.col("page_id") % 5).cast("int"))
    p = table(spark, d, "pages").select("page_id", lang.alias("language"), F.col("html").alias("code"))
    return p.select("page_id", infer_path().alias("path"))


@query
def a3_loaded_rubric(spark, d):
    """A rubric by id, with aliases, patterns that don't compile and rules without any, over all changed lines."""
    rules, _ = load_rubric(RAW_RUBRIC)
    return scans.rubric_findings(inputs.changed_lines(spark, d), rules).select("change_id", "line", "rule_id", "severity", "message")


@query
def a8_stable_names(spark, d):
    return stable_name(table(spark, d, "pages").select(F.col("html").alias("code"))).select("name")


@query
def b1_mixed_lines(spark, d):
    return lines.diff_lines(inputs.mixed_changes(spark, d)).select("change_id", "file_no", "path", "type", "line_number", "other_line", "content", "is_new", "is_deleted")


@query
def b2_mixed_files(spark, d):
    return lines.changed_files(inputs.mixed_changes(spark, d))


@query
def b3_mixed_totals(spark, d):
    return lines.change_totals(lines.changed_files(inputs.mixed_changes(spark, d)))


@query
def b1_diff_lines(spark, d):
    return inputs.changed_lines(spark, d).select("change_id", "path", "type", "line_number", F.md5("content").alias("content_md5"))


@query
def b2_file_changes(spark, d):
    return lines.changed_files(inputs.changes(spark, d)).drop("file_no", "broken")


@query
def b3_change_totals(spark, d):
    return lines.change_totals(lines.changed_files(inputs.changes(spark, d)))


@query
def b4_fallback_totals(spark, d):
    return lines.fallback_totals(inputs.changes(spark, d))


@query
def b4_parse_errors(spark, d):
    cut_off = inputs.changes(spark, d).withColumn("diff", F.when(F.col("change_id") % 7 == 0, F.regexp_replace("diff", "\n[^\n]*$", "")).otherwise(F.col("diff")))
    return lines.parse_errors(cut_off)


@query
def b5_diff_hash(spark, d):
    return inputs.changes(spark, d).select("change_id", lines.diff_hash(F.col("diff")).alias("diff_hash"))


@query
def b6_lanes(spark, d):
    p = table(spark, d, "pages").select(F.concat("url", F.get(F.array(*map(F.lit, (".pdf", ".XLSX", ".png", ".py"))), (F.col("page_id") % 4).cast("int"))).alias("path"), "page_id")
    return p.groupBy(lines.lane(F.col("path")).alias("lane")).agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


@query
def b7_path_classes(spark, d):
    p = F.col("path")
    return inputs.code(spark, d).select("change_id", lines.is_doc(p).alias("is_doc"), lines.is_config(p).alias("is_config"), lines.is_test(p).alias("is_test"), lines.suffix(p).alias("suffix"))


@query
def b8_topic_text(spark, d):
    each = inputs.changed_lines(spark, d)
    return each.select("change_id", "line_number", F.md5(lines.topic_text(F.col("path"), F.col("content"))).alias("topic_md5"))


@query
def c1_zone_hits(spark, d):
    return inputs.hits(spark, d).select("change_id", "file", "line", "zone", "content_preview")


@query
def c4_secret_hits(spark, d):
    return scans.secret_hits(inputs.changed_lines(spark, d)).select("change_id", "file", "line", "kind", "severity", "provable")


@query
def c5_rubric_findings(spark, d):
    return scans.rubric_findings(inputs.changed_lines(spark, d), RUBRIC).select("change_id", "file", "line", "rule_id", "severity", "message")


@query
def c6_merge_zones(spark, d):
    each = inputs.changed_lines(spark, d)
    zones = scans.zone_hits(each, redacted=True)
    return scans.merge_zones(zones, scans.secret_hits(each), zones)


@query
def c7_redaction(spark, d):
    r = scans.redact(table(spark, d, "documents").select("doc_id", "text"), "text", SALT)
    return r.select("doc_id", F.md5("text_redacted").alias("redacted_md5"), F.col("redactions")["email"].alias("n_email"), F.col("redactions")["quoted_token"].alias("n_token"), "changed")


@query
def c10_redactions_by_type(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 100).alias("change_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("type"), F.when(F.col("event_id") % 5 == 0, F.lit("late")).alias("category"), F.when(F.col("event_id") % 2 == 0, F.lit("label")).alias("label"))
    return scans.redactions_by_type(e)


@query
def c9_redacted_records(spark, d):
    """Documents as records: their own text and a field named as a hash that holds the same."""
    r = table(spark, d, "documents").select("doc_id", F.struct(F.col("text").alias("body"), F.col("text").alias("text_hash"), F.struct(F.col("text").alias("root_hash"), F.array("text", "source").alias("parts")).alias("inner"), "n_chars").alias("record"))
    r = scans.redact_record(r, "record", SALT).select("doc_id", "record.*")
    return r.select("doc_id", F.md5("body").alias("body_md5"), F.md5("text_hash").alias("hash_md5"), F.md5("inner.root_hash").alias("root_md5"), F.md5(F.get("inner.parts", 0)).alias("part_md5"), F.get("inner.parts", 1).alias("source"), "n_chars")


def _stages(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("user_id") * 7 % 1000).alias("change_id"), F.col("event_id").alias("stage_no"), F.concat(F.lit("stage-"), "event_type").alias("stage"), (F.col("event_id") % 4 - 1).alias("redaction_count"), (F.col("event_id") % 50 == 0).alias("changed"), F.create_map(F.lit("email"), F.col("event_id") % 3, F.col("event_type"), F.col("event_id") % 2).alias("redactions"))


@query
def c11_sanitization(spark, d):
    return scans.sanitization_summary(_stages(spark, d)).withColumn("applied_to", F.array_join("applied_to", "|"))


@query
def c11_redaction_totals(spark, d):
    return scans.redaction_totals(_stages(spark, d))


LABEL_CASES = ("card_number", "api-key", "Email Address", "size", "credit", "bank_iban", "billing", "PAN", "phi", "personal name", "email_token", "card token", " ", "entropy")


@query
def c12_label_zone(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, LABEL_CASES)), (F.col("p_partkey") % len(LABEL_CASES)).cast("int")).alias("label"))
    return p.select("p_partkey", "label", scans.label_zone(F.col("label")).alias("zone"))


@query
def c13_pii_signals(spark, d):
    """Events as detections of a change for each user, and line items' flags as counts for every order."""
    e, k = table(spark, d, "events"), F.col("event_id")
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    none = F.lit(None).cast("string")
    detections = e.select(F.col("user_id").alias("change_id"), k.alias("seq"), pick("", "email", "api_key", None).alias("type"), pick("phone", None, "size").alias("category"), F.lit("card").alias("label"), none.alias("name"), pick("a.py", "", None).alias("file"), pick(None, "b.py").alias("path"), pick("0", "x", "12", " 7 ", "3.5").alias("line"), pick("", "4").alias("line_number"), F.lit("9").alias("start_line"), pick(None, "").alias("text"), F.col("event_type").alias("value"), none.alias("token"))
    counts = table(spark, d, "orders").select(F.col("o_orderkey").alias("change_id"), pick_column("o_orderstatus", {"F": "ssn", "O": "note", "P": "iban card"}).alias("kind")).groupBy("change_id", "kind").agg(F.count("*").alias("n"))
    return scans.pii_signals(detections, counts)


def pick_column(name, values):
    return fn.literal_map(values)[F.col(name)]


@query
def c14_trigger_hits(spark, d):
    return scans.trigger_hits(table(spark, d, "documents").select(F.col("doc_id").alias("artifact_id"), "text"), PACK)


@query
def c15_control_themes(spark, d):
    return scans.control_themes(c14_trigger_hits(spark, d), THEMES)


def _benchmark_pack(spark, d):
    """Benchmark items as triggers: two words and two pairs of words of each are its keywords, every fifth has a pattern."""
    i = table(spark, d, "benchmark").withColumn("w", packs.words(F.col("text")))
    at = lambda n: F.get("w", F.lit(n))
    keys = F.array_compact(F.array(at(0), F.concat_ws("-", at(3), at(4)), F.upper(F.concat_ws(" ", at(5), at(6))), at(9)))
    return i.select(
        F.lit("benchmark").alias("pack"), F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("trigger_id"), F.when(F.col("item_id") % 3 == 0, "en").alias("artifact_kind"), F.concat(F.lit("level-"), (F.col("item_id") % 4).cast("string")).alias("signal_level"),
        F.concat(F.lit("c"), (F.col("item_id") % 7).cast("string")).alias("category"), F.when(F.col("item_id") % 2 == 0, "control").otherwise("opinionated").alias("finding_type"), F.lit(None).cast("string").alias("description"), keys.alias("keywords"),
        F.when(F.col("item_id") % 40 == 0, "[0-9]{4}-[0-9]{4}").when(F.col("item_id") % 40 == 1, "licensed under|@[a-z]+[.]org").alias("pattern"),
    )


@query
def c14_pack_hits(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("artifact_id"), F.col("lang").alias("artifact_kind"), "text")
    return packs.pack_hits(docs, _benchmark_pack(spark, d)).select("artifact_id", "trigger_id", "category", "signal_level", "finding_type")


@query
def c4_entropy_hits(spark, d):
    """Orders as lines of code: random tokens in base64 and hexadecimal digits, digests, hash fields and dull tokens, in turn."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    noise = F.base64(F.unhex(F.sha2(text, 256)))
    lines_ = (F.concat(F.lit("key = "), noise), F.concat(F.lit("id "), F.md5(text)), F.concat(F.lit("commit "), F.sha1(text)), F.repeat(F.concat(F.lit("ab"), k % 10), 12), F.concat(F.lit('content_hash = "'), F.sha2(text, 256), F.lit('" '), noise), F.concat_ws(" ", F.md5(text), noise, F.lit("no_token_of_letters_alone")))
    content = F.get(F.array(*lines_), (k % len(lines_)).cast("int"))
    rows = table(spark, d, "orders").select(k.alias("change_id"), F.lit("src/a.py").alias("path"), F.lit(1).alias("ord"), F.when(F.col("o_orderstatus") == "P", "remove").otherwise("add").alias("type"), content.alias("content"), (k % 90).cast("int").alias("line_number"))
    return scans.entropy_hits(rows).select("change_id", "file", "line", "token_no", "length", F.round("bits", 6).alias("bits"))


@query
def c4_secret_kinds(spark, d):
    """Orders as lines of code: keys, key ids, credentials and hash fields, in turn."""
    k = F.col("o_orderkey")
    text = F.get(F.array(*map(F.lit, inputs.SECRET_LINES)), (k % len(inputs.SECRET_LINES)).cast("int"))
    text = F.replace(text, F.lit("@"), F.upper(F.substring(F.md5(k.cast("string")), 1, 16)))
    path = F.when(k % 2 == 0, "src/a.py").otherwise("tests/a.py")
    rows = table(spark, d, "orders").select(k.alias("change_id"), F.lit(1).alias("file_no"), path.alias("path"), F.lit(1).alias("ord"), F.lit("add").alias("type"), text.alias("content"), F.lit(1).alias("line_number"))
    found = scoring.zone_findings(scans.zone_hits(rows), scans.secret_hits(rows))
    return found.where("zone = 'entropy_secret'").select("change_id", "rule_id", "severity", "provable")


@query
def c10_reported_redactions(spark, d):
    e = table(spark, d, "events")
    k, u = F.col("event_id"), F.col("user_id")
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    mapped = F.when(k % 3 == 0, F.create_map(F.lit("email"), (u % 9).cast("string"), F.lit("odd"), pick("x", "2.7", " 4 ", None, "-1")))
    listed = F.array(F.struct(pick("", "card", None).alias("type"), pick(None, "", "", "pan").alias("category"), F.when(u % 2 == 0, "label").alias("label")), F.struct(F.lit(None).cast("string").alias("type"), F.lit("").alias("category"), F.lit("").alias("label")))
    r = scans.reported_redactions(e.select(k.alias("change_id"), mapped.alias("redactions_by_type"), listed.alias("redactions")))
    return r.groupBy("change_id", "kind").agg(F.sum("n").alias("n"))


LADDER = [
    {"level": "L0", "score_min": 0, "severity": "info", "label": "Minimal", "required_approvers": []},
    {"level": "L1", "score_min": 20, "severity": "low", "label": "Low", "required_approvers": ["owner"]},
    {"level": "L2", "score_min": 40, "severity": "medium", "label": "Moderate", "required_approvers": ["owner", "peer_reviewer"]},
    {"level": "L3", "score_min": 60, "severity": "high", "label": "High", "required_approvers": ["controller", "compliance"]},
    {"level": "L4", "score_min": 80, "severity": "critical", "label": "Severe", "required_approvers": ["controller", "legal", "release_manager"]},
]


@query
def c16_escalations(spark, d):
    """Balances as scores with fractions, so that some lie between two rules' whole numbers."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 90).alias("score"))
    return packs.escalate(c, "score", LADDER).select("c_custkey", "level", "severity", "label", F.array_join("approvers", ",").alias("approvers"))


@query
def c16_bands(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.least(F.greatest(F.floor(F.col("c_acctbal") / 100), F.lit(0)), F.lit(100)).cast("double").alias("score"))
    return scans.band(c, "score", BANDS)


@query
def d1_path_scores(spark, d):
    return inputs.code(spark, d).select("change_id", scoring.path_score(F.col("path")).alias("score"))


@query
def d2_preliminary_tier(spark, d):
    changes = inputs.changes(spark, d)
    return scoring.preliminary_tier(lines.changed_files(changes), scans.zone_hits(lines.diff_lines(changes)), changes)


@query
def d5_floors(spark, d):
    changes = inputs.changes(spark, d)
    return scoring.floors(lines.changed_files(changes), scans.zone_hits(lines.diff_lines(changes)), changes=changes).drop("parse_error")


@query
def d6_zone_findings(spark, d):
    return inputs.findings(spark, d).drop("seq")


@query
def d7_severity(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", F.upper(F.substring("o_orderpriority", 3, 20)).alias("label"))
    return p.select("o_orderkey", fn.severity(F.col("label")).alias("severity"), fn.severity_rank(F.col("label")).alias("rank"), fn.downgrade(F.col("label")).alias("lower"))


@query
def d8_modulated(spark, d):
    k = F.col("seq.o_orderkey")
    f = inputs.order_findings(spark, d).withColumns({"zone": F.when(k % 3 != 0, F.col("category")), "rule_id": F.when(k % 5 == 0, "RUBRIC-1").otherwise("sensitive-order")})
    c = votes.consensus(inputs.item_reviews(spark, d)).withColumn("protected", F.col("change_id") % 5 == 0)
    return scoring.modulate(f, c).groupBy("change_id", "zone", "rule_id", "severity", "provable").agg(F.count("*").alias("n"))


@query
def d9_concern_findings(spark, d):
    r = inputs.item_reviews(spark, d)
    return scoring.concern_findings(votes.consensus(r).join(votes.combined_concerns(r), "change_id"))


@query
def d10_final_tier(spark, d):
    changes = inputs.changes(spark, d)
    each = lines.diff_lines(changes)
    hits = scans.zone_hits(each)
    return scoring.final_tier(scoring.floors(lines.changed_files(changes), hits, changes=changes), scoring.zone_findings(hits, scans.secret_hits(each))).drop("parse_error")


@query
def d11_zone_drivers(spark, d):
    return scoring.zone_drivers(inputs.hits(spark, d))


@query
def d12_finding_drivers(spark, d):
    return scoring.finding_drivers(inputs.findings(spark, d))


def _drivers(spark, d):
    """Drivers of documents as changes; toxic ones have three concerns. Hits and files serve many joins, so they are kept as a
    scratch table: without it every use would parse and scan the diffs again."""
    hits, secrets, files, totals = scans.scan_once(inputs.changes(spark, d), lambda df: cut(df, "scanned"))
    found = scoring.zone_findings(hits, secrets)
    voiced = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("change_id"), F.array(*map(F.lit, ("Toxic text", "Second look", "Third"))).alias("concerns"))
    return scoring.risk_drivers(hits, found, voiced, files), scoring.final_tier(scoring.floors(files, hits, changes=totals), found), found


@query
def d12_risk_drivers(spark, d):
    return _drivers(spark, d)[0]


@query
def d13_rationales(spark, d):
    drivers, tiers, found = _drivers(spark, d)
    return scoring.rationale(tiers.select("change_id", "tier"), drivers, found)


@query
def e1_validated_reviews(spark, d):
    r = votes.validate_reviews(inputs.order_responses(spark, d))
    scores = F.array_join(F.transform(F.array_sort(F.map_entries("rubric_scores")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
    return r.select("o_orderkey", "summary", "intent", F.array_join("concerns", "|").alias("concerns"), "risk_assessment", "confidence", scores.alias("scores"), "reject_reason")


@query
def e3_consensus(spark, d):
    return votes.consensus(inputs.item_reviews(spark, d))


@query
def e4_combined_concerns(spark, d):
    return votes.combined_concerns(inputs.item_reviews(spark, d)).select("change_id", F.array_join("combined_concerns", "|").alias("concerns"))


@query
def e5_dissent(spark, d):
    r = inputs.item_reviews(spark, d)
    return votes.dissent(r, votes.consensus(r)).select("change_id", F.array_join("dissent", "|").alias("dissent"))


@query
def e6_rubric_averages(spark, d):
    return votes.rubric_averages(inputs.item_reviews(spark, d)).select("change_id", "dimension", F.round("score", 6).alias("score"))


@query
def e7_final_round(spark, d):
    c = table(spark, d, "conversations")
    r = c.select(F.col("conv_id").alias("change_id"), (F.col("turn") + 1).cast("int").alias("round"), F.col("role").alias("voter"), F.when(F.length("text") % 3 == 0, "approve").when(F.length("text") % 3 == 1, "comment").otherwise("request_changes").alias("risk_assessment"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("error"))
    return votes.final_round(r)


@query
def e8_review_health(spark, d):
    return votes.review_health(inputs.item_reviews(spark, d)).select("change_id", "used", "failed", F.array_join("errors", "|").alias("errors"))


@query
def e2_review_slots(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("L"), (F.col("c_custkey") % 5).cast("string")).alias("tier"))
    return t.select("c_custkey", votes.review_slots(F.col("tier")).alias("slots"))


@query
def e9_sealed_reviews(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("prompt"), F.col("text").alias("response"))
    return votes.seal_reviews(c).select("conv_id", "turn", "prompt_hash", "response_hash", F.md5("raw_response").alias("raw_md5"))


@query
def e10_crosscheck_prompts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("change_id"), F.repeat(F.concat(F.lit("-"), "o_orderpriority", F.lit("\n")), (F.col("o_custkey") % 900).cast("int")).alias("diff"))
    return votes.crosscheck_prompts(inputs.item_reviews(spark, d), o).select("change_id", "round", "voter", F.md5("prompt").alias("prompt_md5"))


@query
def e10_review_prompts(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("change_id"), F.col("source").alias("title"), F.col("text").alias("diff"))
    slots = c.select("change_id", F.explode(F.array(F.lit("first"), F.lit("second"))).alias("voter"))
    return votes.review_prompts(slots, c, "Score security from 1 to 5.").select("change_id", "voter", F.md5("prompt").alias("prompt_md5"))


@query
def f5_auto_merge(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, ("merge", "merge-with-conditions", "block"))), (k % 3).cast("int")).alias("decision"), F.concat(F.lit("L"), (k % 5).cast("string")).alias("tier"), (F.col("o_orderstatus") != "P").alias("is_open"), (k % 7 == 0).alias("conflict"))
    return o.select("o_orderkey", decision.auto_merge(F.col("decision"), F.col("tier"), F.col("is_open"), F.col("conflict")).alias("merges"))


def _summaries(spark, d):
    drivers, tiers, found = _drivers(spark, d)
    gates = decision.gate(decision.decide(table(spark, d, "documents").select(F.col("doc_id").alias("change_id")), decision.map_findings(found)), tiers)
    return decision.summary_cards(gates, found, drivers)


@query
def f7_summaries(spark, d):
    return _summaries(spark, d).select("change_id", F.array_join("top", "|").alias("top"), "critical", "high", "other", "drivers", "evidence", "policy", "posture", "gaps")


@query
def f7_summary_lines(spark, d):
    return decision.summary_lines(inputs.findings(spark, d)).select("change_id", "no", "line")


@query
def f7_order_summaries(spark, d):
    """Orders as gated changes: tiers by customer, decisions by their findings, so that either asks for approval."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("change_id"), F.concat(F.lit("L"), (F.col("c_custkey") % 5).cast("string")).alias("tier"))
    found = inputs.order_findings(spark, d).select("change_id", "severity", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.col("description").alias("message"), "seq")
    gates = decision.gate(decision.decide(c, inputs.order_findings(spark, d)), c)
    cards = decision.summary_cards(gates, found, c.where("change_id % 2 = 0").select("change_id"))
    return cards.select("change_id", "evidence", "policy", "posture", "gaps", "drivers", F.md5("card").alias("card_md5"))


@query
def f5_run_status(spark, d):
    k = F.col("o_orderkey") % 4
    o = table(spark, d, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, ("merge", "merge-with-conditions", "block", "odd"))), k.cast("int")).alias("decision"))
    return o.select("o_orderkey", decision.run_status(F.col("decision")).alias("status"), decision.run_status(F.col("decision"), True).alias("strict_status"))


@query
def f3_decisions(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("change_id"))
    r = decision.decide(c, inputs.order_findings(spark, d))
    names = lambda col: F.coalesce(F.array_join(F.transform(col, lambda x: x["description"]), "|"), F.lit(""))
    return r.select("change_id", "decision", decision.verdict(F.col("decision")).alias("verdict"), names("hard_blocks").alias("blocks"), names("conditions").alias("conditions"), names("advisory").alias("advisory"))


@query
def f4_gate(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("change_id"), F.concat(F.lit("L"), (F.col("c_custkey") % 5).cast("string")).alias("tier"))
    r = decision.gate(decision.decide(c, inputs.order_findings(spark, d)), c)
    return r.select("change_id", "tier", "requires_approval", "effective_decision", "n_conditions", "reason")


@query
def f6_cards(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("change_id"))
    return decision.cards(decision.decide(c, inputs.order_findings(spark, d))).select("change_id", F.md5("card").alias("card_md5"))


@query
def f8_latest_cards(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("change_id"), F.struct("ts", "event_id").alias("ts"), F.col("props").alias("card"))
    return decision.latest_cards(e).select("change_id", F.col("ts.event_id").alias("event_id"), "card")


@query
def g3_event_chain(spark, d):
    return evidence.event_chain(inputs.item_events(spark, d)).select("bundle_id", "event_count", "final_hash")


@query
def g5_proof(spark, d):
    return evidence.proof(evidence.items(inputs.item_events(spark, d))).select("bundle_id", "root_hash")


@query
def g6_bundle_ids(spark, d):
    return table(spark, d, "pages").select("page_id", evidence.bundle_id(F.col("url"), F.col("page_id"), F.lit("abc")).alias("bundle_id"))


@query
def g7_zone_summary(spark, d):
    return evidence.zone_summary(inputs.hits(spark, d)).select("change_id", "zone", "hits", F.array_join("files", "|").alias("files"))


@query
def g2_evidence_events(spark, d):
    """Orders as changes: what was submitted, analysed and classified; line items returned are approvals."""
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "bundle_id").withColumn("created_at", F.date_format("o_orderdate", "yyyy-MM-dd"))
    submitted = o.select("bundle_id", "created_at", F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("customer-"), F.col("o_custkey").cast("string"))).alias("actor"), F.col("bundle_id").alias("pr_number"), F.lit("main").alias("base_branch"))
    analysed = o.select("bundle_id", "created_at", F.col("o_orderpriority").alias("preliminary"), (F.col("o_custkey") % 10).alias("files_changed"))
    classified = o.select("bundle_id", "created_at", F.concat(F.lit("L"), (F.col("bundle_id") % 5).cast("string")).alias("risk_tier"))
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("bundle_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("created_at"), (F.col("l_linenumber").cast("long") * 10**9 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("no"), F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("actor"), F.lit("L2").alias("risk_tier_at_approval")).distinct()
    return evidence.evidence_events(submitted, analysed, classified, li)


def _order_bundles(spark, d):
    """Orders as bundles: line items are the events; the head tells what is known of an order."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    heads = o.select(
        k.alias("bundle_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.struct(F.lit("main").alias("base_branch"), F.col("o_custkey").alias("pr_number"), F.lit(None).cast("string").alias("head_branch")).alias("context"),
        F.struct(F.concat(F.lit("L"), (k % 5).cast("string")).alias("risk_tier"), F.concat(F.lit('tier "'), F.col("o_orderpriority"), F.lit('"\n')).alias("rationale"), F.col("o_totalprice").alias("score"), (k % 5 >= 3).alias("requires_approval")).alias("summary"),
        F.struct((F.col("o_totalprice") * 1e14).alias("lines"), F.array("o_orderstatus", "o_orderpriority").alias("zones"), F.create_map(F.lit("b"), k, F.lit("a"), F.col("o_custkey")).alias("counts")).alias("analysis_snapshot"),
    )
    return evidence.bundles(inputs.item_events(spark, d), heads)


@query
def g8_sealed(spark, d):
    return _order_bundles(spark, d).select("bundle_id", F.col("hash_chain.final_hash").alias("final_hash"), F.col("immutability_proof.root_hash").alias("root_hash"), "bundle_hash")


@query
def g9_verified(spark, d):
    """Bundles of all orders: some as sealed, most changed after that; each kind of change by the order's key."""
    b = _order_bundles(spark, d)
    k = F.col("bundle_id") % 14
    forged = F.transform("events", lambda x, i: F.when(i == F.floor(F.size("events") / 2), x.withField("data", F.lit("forged"))).otherwise(x))
    none = lambda c, *which: F.when(~k.isin(*which), F.col(c))
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in b.schema["summary"].dataType])
    changed = {
        "summary": F.when(k == 1, F.col("summary").withField("risk_tier", F.lit("L9"))).when(k == 9, empty).when(k != 11, F.col("summary")),
        "context": F.when(k == 3, F.col("context").withField("base_branch", F.lit("other"))).when(~k.isin(9, 10, 11), F.col("context")),
        "events": F.when(k == 4, forged).when(k == 5, F.reverse("events")).when(k == 7, F.slice("events", 1, 0)).otherwise(F.col("events")),
        "items": F.when(k == 6, F.transform("items", lambda x: x.withField("content_hash", F.lit("0")))).when(~k.isin(9, 10, 11), F.col("items")),
        "analysis_snapshot": F.when(k == 12, F.col("analysis_snapshot").withField("lines", F.lit(0.0))).when(~k.isin(9, 10, 11), F.col("analysis_snapshot")),
        "hash_chain": F.when(k == 8, F.col("hash_chain").withField("final_hash", F.lit("0"))).otherwise(F.col("hash_chain")),
        "immutability_proof": none("immutability_proof", 9, 10, 11), "version": none("version", 9, 10, 11), "spec_version": none("spec_version", 9, 10, 11), "bundle_hash": none("bundle_hash", 2, 9, 10, 11),
    }
    b = b.withColumns(changed)
    # One kind is sealed again after its change, and so is sound.
    again = evidence.seal(b.where(k == 13).withColumn("summary", F.col("summary").withField("rationale", F.lit("redacted"))))
    return evidence.verify(b.where(k != 13).unionByName(again))


@query
def g9_proofs(spark, d):
    b = _order_bundles(spark, d)
    k = F.col("bundle_id") % 4
    last = F.size("items") - 1
    cut_item = F.transform("items", lambda x, i: F.when(i == last, x.withField("content_hash", F.lit("0"))).otherwise(x))
    cut_link = F.transform("immutability_proof.hash_chain", lambda x, i: F.when(i == last, x.withField("previous_hash", F.lit("0"))).otherwise(x))
    proof = F.when(k == 2, F.col("immutability_proof").withField("hash_chain", cut_link)).when(k == 3, F.col("immutability_proof").withField("root_hash", F.lit("0"))).otherwise(F.col("immutability_proof"))
    return evidence.verify_proof(b.withColumns({"items": F.when(k == 1, cut_item).otherwise(F.col("items")), "immutability_proof": proof}))


@query
def g10_bundles(spark, d):
    return evidence.bundle_documents(_order_bundles(spark, d)).select("bundle_id", F.md5("document").alias("document_md5"))


@query
def h5_documents(spark, d):
    doc = export.documents(inputs.findings(spark, d))
    return doc.select("change_id", F.get_json_object("document", "$.version").alias("version"), F.json_array_length(F.get_json_object("document", "$.runs[0].results")).alias("n"), F.get_json_object("document", "$.runs[0].results[0].rule_id").alias("first_rule"))


@query
def h1_rules(spark, d):
    return export.rules(inputs.findings(spark, d))


@query
def h2_results(spark, d):
    return export.results(inputs.findings(spark, d)).select("change_id", "rule_id", "level", "file", "line", F.array_join("tags", ",").alias("tags"), "fingerprint")


@query
def h6_deduped(spark, d):
    return export.dedupe(inputs.findings(spark, d))


def _scored(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    truth = docs.join(labels, "doc_id").select(F.col("doc_id").alias("change_id"), F.col("source").alias("dataset"), F.when(F.col("toxic") == 1, "vulnerable").when(F.col("quality") == 0, "introducing").otherwise("clean").alias("category"), (F.col("toxic") == 1).alias("expected_flag"))
    made = assess(inputs.changes(spark, d)).withColumn("consensus_risk", F.when(F.col("change_id") % 3 == 0, "comment").otherwise("approve"))
    return evaluation.score_results(made, truth)


@query
def i2_eval_stats(spark, d):
    return evaluation.stats(_scored(spark, d))


@query
def i3_eval_rollup(spark, d):
    return evaluation.rollup(_scored(spark, d)).select("dataset", "category", "level", "total", "excluded", "correct", "fp", "fn", "accuracy_pct", "fn_rate_pct")


@query
def i4_tier_distribution(spark, d):
    return evaluation.tier_distribution(_scored(spark, d))


@query
def i5_failures(spark, d):
    return evaluation.failures(_scored(spark, d))


@query
def i8_confusion(spark, d):
    r = table(spark, d, "part").select((F.col("p_size") % 5).alias("expected"), (F.floor(F.col("p_retailprice")) % 5).cast("int").alias("found"))
    return evaluation.confusion(r)


@query
def i6_detected(spark, d):
    """Documents as stored answers: their language and source are signals, their words the text; labels set flag and level."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    expected, found = F.array(F.lit("wiki"), F.lit("LICENSED")), F.array("lang", "source")
    return docs.select("doc_id", evaluation.detected(expected, found, F.coalesce(F.col("toxic") == 1, F.lit(False)), F.when(F.col("quality") == 0, 1).otherwise(0), F.col("text")).alias("detected"))


@query
def i7_class_match(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", evaluation.class_match(F.col("p_size") % 5, (F.floor(F.col("p_retailprice")) % 5).cast("int")).alias("matches"))


@query
def i8_level_rates(spark, d):
    p = table(spark, d, "part").select((F.col("p_size") % 5).alias("expected"), (F.floor(F.col("p_retailprice")) % 3 > 0).alias("detected"))
    return evaluation.level_rates(p)


@query
def i9_hit_rate(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.array("l_returnflag", "l_linestatus").alias("signals"), F.array(F.lit("R"), F.lit("O")).alias("expected"))
    return evaluation.hit_rate(v).select("case_id", F.round("hit_rate", 9).alias("hit_rate"))


@query
def i11_council_scores(spark, d):
    """Orders as cases, their line items' suppliers as the findings that the consensus names; parts' rows describe some."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    cases = o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 5).alias("expected"), (F.col("o_orderkey") % 5).alias("found"))
    named = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("finding_id")).distinct()
    findings = named.where("finding_id % 4 <> 0").select("case_id", F.col("finding_id").alias("id"), F.when(F.col("finding_id") % 3 != 0, "mend").otherwise("").alias("remediation"), F.when(F.col("finding_id") % 5 != 0, F.array(F.lit("a.py"))).alias("file_paths"))
    return evaluation.council_scores(cases, named, findings).withColumn("actionability", F.round("actionability", 9))


@query
def i13_defaults(spark, d):
    """Event properties as stored outputs, some with more fields."""
    full = F.concat(F.lit('{"detected":true,"risk_level":'), (F.col("event_id") % 5).cast("string"), F.lit(',"signals":["a"],"council":{"enabled":true}}'))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, full).otherwise(F.col("props")).alias("output"))
    r = evaluation.apply_defaults(e)
    return r.select("event_id", "detected", "risk_level", F.array_join("signals", "|").alias("signals"), F.col("council.enabled").alias("enabled"), F.col("council.consensus")["risk_level"].alias("consensus_level"), F.array_join("warnings", "|").alias("warnings"))


@query
def i10_round_deltas(spark, d):
    c = table(spark, d, "conversations").where("turn < 2").select(F.floor(F.col("conv_id") / 2).alias("case_id"), F.concat((F.col("conv_id") % 2).cast("string")).alias("voter"), (F.col("turn") + 1).alias("round"), (F.length("text") % 5).alias("level"), (F.length("text") % 3).alias("added"), (F.length("text") % 2).alias("rejected"))
    return evaluation.round_deltas(c)


@query
def i12_voter_report(spark, d):
    return evaluation.voter_report(i10_round_deltas(spark, d))


def _numbers(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("change_id"), F.col("l_partkey").alias("line_number"))


@query
def j1_deleted_ranges(spark, d):
    return origins.deleted_ranges(_numbers(spark, d), ("change_id",))


@query
def j2_context_ranges(spark, d):
    return origins.context_ranges(_numbers(spark, d), 5, ("change_id",))


@query
def j3_prioritised(spark, d):
    c = inputs.code(spark, d).select((F.col("change_id") % 50).alias("change_id"), "path")
    return origins.prioritise(c)


@query
def j4_candidates(spark, d):
    """Ranges of part numbers by supplier against all parts as attributed lines: a part's brand is its commit."""
    r = origins.context_ranges(_numbers(spark, d), 5, ("change_id",)).withColumn("path", F.lit("parts"))
    blame = table(spark, d, "part").select(F.lit("parts").alias("path"), F.col("p_partkey").alias("line_no"), F.col("p_brand").alias("sha"), F.col("p_size").alias("commit_date"))
    return origins.candidates(r, blame)


@query
def j5_ranked_candidates(spark, d):
    merges = table(spark, d, "part").where("p_size = 50").select(F.col("p_brand").alias("sha")).where("sha like '%5'").distinct()
    return origins.rank_candidates(j4_candidates(spark, d), merges).select("change_id", "sha", "commit_date", "rank")


@query
def j6_clean_sample(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("change_id"), F.col("source").alias("repo"))
    return origins.clean_sample(lines.changed_files(inputs.changes(spark, d)), docs)


@query
def j5_origin_flags(spark, d):
    """Suppliers as fixes: deleted lines are their part numbers, in files by the number's last digits; some have only context."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("change_id"), F.col("l_partkey").alias("line_number"), F.concat(F.lit("f"), (F.col("l_partkey") % 60).cast("string")).alias("path"))
    fixes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("change_id"), F.when(F.col("s_suppkey") % 11 == 0, " \n").otherwise("diff").alias("diff"))
    s = F.col("change_id")
    deleted, context = origins.deleted_ranges(li.where(s % 3 != 0)), origins.context_ranges(li.where(s % 7 != 0))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("line_number"), F.col("p_brand").alias("sha"), F.col("p_size").alias("commit_date"))
    found = li.where(s % 4 != 0).join(parts, "line_number").groupBy("change_id", "sha").agg(F.min("commit_date").alias("commit_date"))
    ranked = origins.rank_candidates(found, parts.where("sha like '%5'").select("sha").distinct())
    initial = parts.where("sha like '%1'").select("sha").distinct()
    return origins.origin_flags(fixes, deleted, context, ranked, initial).withColumn("flags", F.array_join("flags", "|"))


@query
def j7_reversed(spark, d):
    r = lines.reverse_lines(lines.diff_lines(inputs.mixed_changes(spark, d)))
    return r.select("change_id", "path", "type", "line_number", "other_line", "content", "is_new", "is_deleted")


@query
def l1_assessed(spark, d):
    """The whole chain: the flagship query."""
    return assess(inputs.changes(spark, d)).drop("parse_error")


@query
def l4_window_counts(spark, d):
    """The streaming job's plan over the whole table; tests run it as a stream."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return window_counts(e).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
