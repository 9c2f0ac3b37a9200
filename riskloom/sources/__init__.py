"""Readers and writers of changes, rules, manifests and results."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.config import SEVERITIES
from riskloom.functions import literal_map


def read_patches(spark: SparkSession, root: str) -> DataFrame:
    """path, dataset, category, expected_flag, diff of all *.patch files below root: dataset/.../category/name.patch."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.patch").load(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), rf"^.*\Q{root.rstrip('/').split('/')[-1]}\E/", "")
    return raw.select(path.alias("path"), F.regexp_extract(path, r"^([^/]+)/", 1).alias("dataset"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("category"), F.col("value").alias("diff")).withColumn("expected_flag", F.col("category") == "vulnerable")


#: What ends a line of code, and white space around a value.
LINE_END, AROUND = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", r"(?U)^\s+|\s+$"


def read_labelled_code(spark: SparkSession, path: str, language: str, most: int | None = None, least_lines: int = 5, most_lines: int = 200) -> DataFrame:
    """code, label (vulnerable or clean), n_lines, file and position of the rows in one language that are of 5 to 200 lines:
    the first `most` of each label in the order of files, by name, and of rows in them. CSV with quoted line breaks.

    Such a file is read by one task, so its rows are numbered as they come; the first of each label are a limit over an
    order, of which every task sends no more than `most` rows on.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"').select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("position"))
    trimmed = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), AROUND, "")
    code, safety = trimmed("code"), F.lower(trimmed("safety"))
    label = F.when(safety.isin("0", "vulnerable", "unsafe"), "vulnerable").when(safety.isin("1", "safe", "clean"), "clean")
    n = F.when(code == "", 0).otherwise(F.size(F.split(code, LINE_END)))
    df = raw.where(F.lower(trimmed("language")) == language.lower()).select(code.alias("code"), label.alias("label"), n.alias("n_lines"), "file", "position").where(F.col("label").isNotNull() & F.col("n_lines").between(least_lines, most_lines))
    if most is None:
        return df
    first = [df.where(F.col("label") == kind).orderBy("file", "position").limit(most) for kind in ("vulnerable", "clean")]
    return first[0].unionByName(first[1])


# Extensions by language, and plausible paths by what the code holds, in order.
EXTENSIONS = {"python": ".py", "javascript": ".js", "typescript": ".ts", "java": ".java", "c": ".c", "cpp": ".cpp", "c++": ".cpp", "php": ".php", "ruby": ".rb", "go": ".go", "rust": ".rs"}
PYTHON_HINTS = {
    r"from django|from rest_framework": "src/web/views",
    r"import flask|from flask": "src/web/app",
    r"import sqlite3|import psycopg|import pymysql": "src/db/queries",
    r"import os\b|import subprocess": "src/utils/system",
    r"import pickle|import yaml|import marshal": "src/utils/loader",
    r"import hashlib|import hmac|from cryptography": "src/auth/crypto",
    r"import jwt|import session|login|password": "src/auth/session",
    r"import socket|import requests|import urllib": "src/net/client",
}
SCRIPT_HINTS = {
    r"require\(['\"]express|app\.get\(|app\.post\(": "src/routes/handler",
    r"require\(['\"]mysql|require\(['\"]pg|query\(": "src/db/queries",
    r"document\.|innerHTML|\.html\(": "src/web/views",
    r"exec\(|spawn\(|child_process": "src/utils/system",
    r"require\(['\"]fs|readFile|writeFile": "src/utils/files",
    r"jwt\.|token|session|cookie": "src/auth/session",
}


def infer_path(language: str = "language", code: str = "code") -> Column:
    """A plausible path: by the first of the language's hints in the code, else src/module, with the language's extension."""
    lang = F.col(language)
    base = F.lit("src/module")
    for names, hints in ((("javascript", "typescript"), SCRIPT_HINTS), (("python",), PYTHON_HINTS)):
        for pattern, place in reversed(hints.items()):
            base = F.when(lang.isin(*names) & F.col(code).rlike("(?iuUd)" + pattern), place).otherwise(base)
    return F.concat(base, F.coalesce(literal_map(EXTENSIONS)[lang], F.lit(".txt")))


def stable_name(df: DataFrame, code: str = "code") -> DataFrame:
    """Adds name: the row's number in the order of the code's hash, and the first of that hash.

    Rows are numbered within ranges of the hash, and the ranges' small table of counts says where each starts.
    """
    d = df.withColumn("_md5", F.md5(code)).withColumn("_range", F.substring("_md5", 1, 3))
    own = Window.partitionBy("_range").orderBy("_md5", code)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    j = d.withColumn("_own", F.row_number().over(own)).join(starts, "_range")
    return j.withColumn("name", F.concat(F.format_string("cve_%04d_", F.col("_start") + F.col("_own") - 1), F.substring("_md5", 1, 8))).drop("_md5", "_range", "_own", "_start")


# Other names of the built-in rubrics.
RUBRIC_ALIASES = {"soc2": "soc2-controls", "hipaa": "hipaa-safeguards", "pci-dss": "pci-dss-requirements"}
#: What a rule says where it doesn't say itself.
UNSAID = {"severity": "medium", "message": "Policy rule triggered"}


@dataclass(frozen=True)
class RawRule:
    """A rule as written: its name, what it holds, and its patterns in order."""

    name: str
    held: dict
    patterns: tuple[str, ...]

    @staticmethod
    def of(name: str | None, number: int, body) -> RawRule | str:
        """The rule, or what is wrong with it. A rule named by its place in a mapping may be its pattern alone."""
        if name is not None and not isinstance(body, dict):
            body = {"pattern": str(body)}
        if not isinstance(body, dict):
            return f"rule {number}: not a mapping"
        several = body.get("patterns")
        every = chain([body.get("pattern")], several if isinstance(several, list) else [several])
        return RawRule(str(body.get("id") or name or f"rule_{number}"), body, tuple(p for p in every if isinstance(p, str)))

    def problems(self) -> list[str]:
        return [f"{self.name}: bad pattern {p}" for p in self.patterns if not _compiles(p)] if self.patterns else [f"{self.name}: no pattern"]

    def rule(self) -> dict:
        spared, level = self.held.get("exceptions", ()), str(self.held.get("severity", UNSAID["severity"])).strip().lower()
        spared = [spared] if isinstance(spared, str) else spared if isinstance(spared, (list, tuple)) else []
        told = next(filter(None, (self.held.get("message"), self.held.get("description"))), UNSAID["message"])
        return {"id": self.name, "severity": level if level in SEVERITIES else "critical", "message": told, "category": self.held.get("category"), "name": self.held.get("name"), "patterns": list(filter(_compiles, self.patterns)), "exceptions": list(map(str, spared))}


def load_rubric(source: str | dict | list) -> tuple[list[dict], list[str]]:
    """(rules, errors) of a rubric: a YAML or JSON file, or what such a file holds; rules as a list, or by id.

    A rule's pattern and patterns are taken together; those that don't compile are left out and told of, and so is a rule
    of another shape or without a pattern. Severity is medium where none is given and critical where it is unknown.
    """
    held = _parsed(source) if isinstance(source, str) else source
    held = held.get("rules") if isinstance(held, dict) else held
    named = held.items() if isinstance(held, dict) else ((None, x) for x in (held if isinstance(held, list) else ()))
    raw = [RawRule.of(name, number, body) for number, (name, body) in enumerate(named)]
    errors = list(chain.from_iterable([r] if isinstance(r, str) else r.problems() for r in raw))
    rules = [rule for rule in (r.rule() for r in raw if isinstance(r, RawRule)) if rule["patterns"]]
    return rules, errors


def rubric_path(name: str, folder: str) -> str:
    """The file of a rubric: a path as it is, else the built-in one of that name, or of the name that it is short for."""
    if "/" in name or name.endswith((".yaml", ".yml", ".json")):
        return name
    return f"{folder.rstrip('/')}/{RUBRIC_ALIASES.get(name.lower(), name.lower())}.yaml"


@lru_cache(maxsize=4096)
def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _parsed(path: str):
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f) or {}


def rubric_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """The rules as a table: id, severity, message, category, name, patterns, exceptions."""
    return spark.createDataFrame([tuple(r.get(c) for c in ("id", "severity", "message", "category", "name", "patterns", "exceptions")) for r in rules], "id string, severity string, message string, category string, name string, patterns array<string>, exceptions array<string>")


MANIFEST = "repo string, cve_id string, cwe string, severity string, fix_commit string, introducing_commit string, description string, introducing_reasoning string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """patch (the name of a patch file, from the id of its vulnerability) and the columns of MANIFEST, the last record of each
    patch in the order of the file: `vulnerabilities` of a JSON file, or of a YAML one where a YAML library is installed."""
    if path.endswith((".yaml", ".yml")):
        rows = spark.createDataFrame([(i, json.dumps(r, default=str)) for i, r in enumerate(_parsed(path).get("vulnerabilities") or [])], "no long, r string").select("no", F.from_json("r", MANIFEST).alias("r"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"vulnerabilities array<struct<{MANIFEST.replace(' string', ':string')}>>").alias("v"))
        rows = whole.select(F.posexplode("v.vulnerabilities").alias("no", "r"))
    named = rows.withColumn("patch", F.concat(F.replace(F.lower(F.coalesce("r.cve_id", F.lit(""))), F.lit("-"), F.lit("_")), F.lit(".patch")))
    return named.groupBy("patch").agg(F.max_by("r", "no").alias("r")).select("patch", "r.*")


def with_manifest(patches: DataFrame, manifest: DataFrame) -> DataFrame:
    """Patches (path, ...) with what the manifest knows of their file's name; those it doesn't know have nulls."""
    own = [c for c in manifest.columns if c != "patch" and c not in patches.columns]
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return patches.withColumn("_name", name).join(manifest.select(F.col("patch").alias("_name"), *own), "_name", "left").drop("_name")


# Writers, one for each shape. A run replaces the folders of the tiers or dates that it has rows of, and no others: what is
# written twice is there once.


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a local one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: no lineage to recompute when an executor is lost."""
    return written(df, f"{scratch_dir(df.sparkSession)}/riskloom-{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _replace(df: DataFrame, path: str, by: list[str], kind: str = "json") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(kind).save(path)


def write_bundles(documents: DataFrame, path: str) -> None:
    """bundle_id, tier, document (canonical JSON) -> a folder for each tier, a line for each bundle. The document is kept as
    text: parsed and written again it would no longer be what the seal covers."""
    _replace(documents.select(F.coalesce("tier", F.lit("none")).alias("tier"), "document"), path, ["tier"], "text")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """bundle_id, tier and document of what write_bundles wrote."""
    return spark.read.text(path).select(F.get_json_object("value", "$.bundle_id").alias("bundle_id"), "tier", F.col("value").alias("document"))


def write_exports(documents: DataFrame, path: str, date: str) -> None:
    """change_id, document -> the findings of a day's run as one line of JSON for each change, in the folder of its date."""
    _replace(documents.select(F.lit(date).alias("date"), F.to_json(F.struct("change_id", F.col("document"))).alias("value")), path, ["date"], "text")


def write_evaluations(results: DataFrame, path: str, date: str) -> None:
    """Rows of an evaluation as JSON, by date and dataset."""
    _replace(results.withColumns({"date": F.lit(date), "dataset": F.coalesce("dataset", F.lit("none"))}), path, ["date", "dataset"])


APPROVAL = ("repository", "pr_number", "commit_sha", "risk_tier", "decision", "bundle_id", "findings_count", "hard_blocks", "conditions", "created_at")


def approval_records(gates: DataFrame, heads: DataFrame, bundle_ids: DataFrame, findings: DataFrame) -> DataFrame:
    """The columns of APPROVAL: one record for each gated change. gates: see decision.gate; heads: change_id, repository,
    pr_number, commit_sha, created_at; bundle_ids: change_id, bundle_id; findings: change_id."""
    n = findings.groupBy("change_id").agg(F.count("*").alias("findings_count"))
    j = gates.select("change_id", F.col("tier").alias("risk_tier"), F.col("effective_decision").alias("decision"), F.greatest(F.size(F.coalesce("hard_blocks", F.array())), F.lit(0)).alias("hard_blocks"), F.col("n_conditions").alias("conditions"))
    j = j.join(heads, "change_id").join(bundle_ids.select("change_id", "bundle_id"), "change_id", "left").join(n, "change_id", "left")
    return j.withColumns({"findings_count": F.coalesce("findings_count", F.lit(0)), "bundle_id": F.coalesce(F.col("bundle_id").cast("string"), F.lit(""))}).select(*APPROVAL)


def write_approvals(records: DataFrame, path: str) -> None:
    """Approval records as Parquet, by tier and the date of created_at."""
    _replace(records.withColumn("date", F.substring(F.col("created_at").cast("string"), 1, 10)), path, ["risk_tier", "date"], "parquet")
