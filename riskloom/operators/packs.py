"""Trigger packs: many keywords and patterns against many artifacts, and ladders that turn scores into approvers.

Keywords are looked up, not searched for: every artifact's distinct word sequences, as long as a keyword is, meet an index
of the keywords in one equality join, whose cost doesn't depend on how many keywords there are. Patterns, of which a pack
has few, are literals of the plan.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import let

TRIGGER = "pack string, trigger_id string, artifact_kind string, signal_level string, category string, finding_type string, description string, keywords array<string>, pattern string"
#: What lies between words, once A-Z and their like are lowered.
GAP = r"[^\p{L}\p{N}_]+"


def read_pack(source: str | dict) -> dict:
    """A pack from a JSON or YAML file (where a YAML library is installed), or as it is: name, triggers, severity bands,
    escalation rules and control mappings. Triggers need an id and a keyword or a pattern; what lacks them is an error."""
    if isinstance(source, str):
        with open(source, encoding="utf-8") as f:
            if source.endswith(".json"):
                source = json.load(f)
            else:
                import yaml

                source = yaml.safe_load(f)
    for t in source.get("triggers", ()):
        if not t.get("trigger_id") or not (t.get("keywords") or t.get("pattern")):
            raise ValueError(f"a trigger needs an id and keywords or a pattern: {t}")
    return source


def pack_table(spark: SparkSession, packs: Iterable[dict]) -> DataFrame:
    """The triggers of packs as a table of TRIGGER: a pack is a file's worth of settings."""
    names = [c.split()[0] for c in TRIGGER.split(", ")]
    rows = [tuple(p.get("name") or p.get("pack_id") if c == "pack" else t.get(c) for c in names) for p in packs for t in p.get("triggers", ())]
    return spark.createDataFrame(rows, TRIGGER)


def words(text: Column) -> Column:
    """The lower-case words of a text: runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def keyword_index(triggers: DataFrame) -> DataFrame:
    """sequence, n_words and the trigger (pack, trigger_id, artifact_kind) for each distinct keyword with a word in it."""
    own = triggers.select("pack", "trigger_id", "artifact_kind", F.explode("keywords").alias("k")).select("pack", "trigger_id", "artifact_kind", words(F.col("k")).alias("w")).where(F.size("w") > 0)
    return own.select(F.array_join("w", " ").alias("sequence"), F.size("w").alias("n_words"), "pack", "trigger_id", "artifact_kind").distinct()


def sequences(own: Column, longest: int) -> Column:
    """All distinct runs of 1 to `longest` words of an array, each joined by spaces."""
    runs = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return let(own, lambda w: F.array_distinct(F.flatten(F.array(*[w if n == 1 else runs(w, n) for n in range(1, longest + 1)]))))


def pack_hits(artifacts: DataFrame, triggers: DataFrame, longest: int = 4) -> DataFrame:
    """artifact_id, pack, trigger_id, category, signal_level, finding_type: once for each trigger of a table of TRIGGER that
    fires for an artifact (artifact_id, artifact_kind, text) of its kind: one of its keywords is there, as whole words in
    any case and whatever separates them, or its pattern matches (any case).

    A trigger or artifact without a kind goes with all. Null texts fire nothing; keywords of more than `longest` words are an
    error. Rows that repeat an artifact's id fire together. Patterns are read from the table: they are settings.
    """
    index = keyword_index(triggers)
    if (most := index.agg(F.max("n_words")).first()[0] or 0) > longest:
        raise ValueError(f"a keyword has {most} words; longest is {longest}")
    kind = lambda a, b: F.coalesce(a == b, F.lit(True))
    own = artifacts.select("artifact_id", F.col("artifact_kind").alias("_kind"), F.explode(sequences(words(F.col("text")), max(most, 1))).alias("_sequence"))
    by_word = own.join(index, F.col("_sequence") == F.col("sequence")).where(kind(F.col("_kind"), F.col("artifact_kind"))).select("artifact_id", "pack", "trigger_id")
    patterns = triggers.where("pattern is not null and pattern <> ''").select("pack", "trigger_id", "artifact_kind", "pattern").collect()
    tests = [F.when(F.col("text").rlike("(?iuUd)" + p.pattern) & (kind(F.col("artifact_kind"), F.lit(p.artifact_kind)) if p.artifact_kind else F.lit(True)), F.struct(F.lit(p.pack).alias("pack"), F.lit(p.trigger_id).alias("trigger_id"))) for p in patterns]
    found = by_word
    if tests:
        # An outer explode: for an inner one the planner runs all patterns once more below it.
        hit = artifacts.select("artifact_id", F.explode_outer(F.array_compact(F.array(*tests))).alias("_hit")).where("_hit is not null")
        found = found.unionByName(hit.select("artifact_id", "_hit.pack", "_hit.trigger_id"))
    told = triggers.select(F.col("pack").alias("_p"), F.col("trigger_id").alias("_t"), "category", "signal_level", "finding_type")
    return found.distinct().join(told, F.col("pack").eqNullSafe(F.col("_p")) & (F.col("trigger_id") == F.col("_t"))).select("artifact_id", "pack", "trigger_id", "category", "signal_level", "finding_type")


def ladder(rules: list[dict]) -> Column:
    """Escalation rules or bands as a literal array, lowest first: structs of score_min, level, severity, label, approvers."""
    keys = ("level", "severity", "label")
    rows = sorted(rules, key=lambda r: r.get("score_min", r.get("min_score")))
    text = lambda v: F.lit(None if v is None else str(v)).cast("string")
    own = [F.struct(F.lit(float(r.get("score_min", r.get("min_score")))).alias("score_min"), *[text(r.get(k)).alias(k) for k in keys], F.array(*map(F.lit, r.get("required_approvers", ()))).cast("array<string>").alias("approvers")) for r in rows]
    return F.array(*own)


def escalate(df: DataFrame, score: str, rules: list[dict]) -> DataFrame:
    """df with level, severity, label and approvers of the highest rule whose score_min (or min_score) the score reaches.

    Only lower bounds count, so no score falls into a gap between two rules; one below all of them, or null, has nulls.
    Rules are settings, so the lookup is a literal of the plan and no join.
    """
    step = F.element_at(F.filter(ladder(rules), lambda r: r["score_min"] <= F.col(score).cast("double")), -1)
    step = F.when(F.size(F.filter(ladder(rules), lambda r: r["score_min"] <= F.col(score).cast("double"))) > 0, step)
    return df.withColumn("_rule", step).select(*df.columns, "_rule.level", "_rule.severity", "_rule.label", "_rule.approvers")


def mapped_themes(hits: DataFrame, mappings: list[dict]) -> DataFrame:
    """artifact_id, theme: the control themes (theme, trigger_categories) that the categories of an artifact's hits stand for."""
    out = [F.when(F.col("category").isin(*m["trigger_categories"]), m["theme"]) for m in mappings]
    return hits.select("artifact_id", F.explode(F.array_compact(F.array(*out))).alias("theme")).distinct()
