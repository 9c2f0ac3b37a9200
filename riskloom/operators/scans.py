"""Scans of changed lines: sensitive zones, secrets, rubric rules, redaction, and packs of triggers.

Patterns are literals in the plan, compiled once; a scan is one projection over the lines and needs no shuffle.
"""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from riskloom.config import HASH_FIELD, TOPIC_ZONES, ZONES
from riskloom.functions import let, literal_map, severity
from riskloom.operators.lines import FILE, LINE, is_doc, is_test, marks, parsed, topic_text

#: Unicode classes and case folding, and lines that end at a newline only, for patterns where these can matter.
EXACT = "(?iuUd)"


def _flags(pattern: str) -> str:
    return EXACT if any(x in pattern for x in (r"\w", r"\s", r"\b", ".*", "$")) else "(?iu)"


def needed(pattern: str) -> list[str]:
    """Texts in lower case of which every match of a pattern holds one: the longest plain run of each alternative. Empty where
    an alternative has none."""
    inner = pattern[1:-1] if re.fullmatch(r"\((?!\?)(?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)", pattern) else pattern
    runs, depth = [[""]], 0
    for token in re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|\{[^}]*\}|.", inner, re.S):
        depth += (token == "(") - (token == ")")
        if depth == 0 and token == "|":
            runs.append([""])
        elif depth or token == ")":
            runs[-1].append("")
        elif re.fullmatch(r"[A-Za-z0-9_<=/ -]|\\[^A-Za-z0-9]", token):
            runs[-1][-1] += token[-1]
        else:
            # What is repeated or left out at will is in no run.
            runs[-1][-1] = runs[-1][-1][:-1] if token[0] in "?*{" else runs[-1][-1]
            runs[-1].append("")
    longest = [max(r, key=len).lower() for r in runs]
    return longest if all(len(t) > 1 for t in longest) and pattern.isascii() and not re.search(r"\\(?![bBdDsSwW])[A-Za-z0-9]|\(\?[a-z-]+[):]", pattern) else []


def openers(pattern: str) -> list[str]:
    """As needed, for patterns, too, that are of any case by a flag in front, or start with a group of alternatives."""
    bare = pattern.removeprefix("(?i)")
    group = re.fullmatch(r"(?:\\b)?\(\?:([^()]*)\)(?![?*{])[^|]*", bare, re.S)
    return needed(bare) or (needed(group[1]) if group else [])


def plain(text: Column) -> Column:
    """A text in lower case, with the few other letters that equal one of a to z in any case as that one."""
    others = {"\u017f": "s", "\u212a": "k", "\u0130": "i", "\u0131": "i"}
    swapped = F.lower(F.translate(text, "".join(others), "".join(others.values())))
    return F.when((F.octet_length(text) == F.length(text)) | ~reduce(lambda a, b: a | b, map(text.contains, others)), F.lower(text)).otherwise(swapped)


def matches(text: Column, low: Column, pattern: str, flags: str) -> Column:
    """Whether a pattern of any case is found; low, the plain text, tells first whether it can be, which costs far less."""
    texts, test = openers(pattern), text.rlike(flags + pattern)
    return reduce(lambda a, b: a | b, [low.contains(t) for t in texts]) & test if texts else test


def possible(low: Column, texts: list[list[str]]) -> Column:
    """A number with a bit for each list of plain texts (63 at most), set where low, a plain text, holds one of them. Arrow's
    search reads a text once for all of a list, where each `contains` reads it again."""
    patterns = ["|".join(map(re.escape, own)) for own in texts]

    @F.arrow_udf("long")
    def bits(values: pa.Array) -> pa.Array:
        # As bytes: what is no UTF-8 is searched, too.
        out, values = pa.repeat(pa.scalar(0, pa.int64()), len(values)), values.cast(pa.binary())
        for i, p in enumerate(patterns):
            out = pc.bit_wise_or(out, pc.multiply(pc.fill_null(pc.match_substring_regex(values, p), False).cast(pa.int64()), 1 << i))
        return out

    return bits(low)


def _found(rows: DataFrame, tests: list[Column]) -> DataFrame:
    """A row for each test that gives a value, as _hit. An outer explode: for an inner one the planner adds a filter on
    the array's size below it, which runs all patterns once more."""
    return rows.withColumn("_hit", F.explode_outer(F.array_compact(F.array(*tests)))).where(F.col("_hit").isNotNull())


def preview(content: Column, redacted: bool) -> Column:
    """The first 100 characters, trimmed; a mark instead where a redacted copy of the change exists."""
    return F.lit("[REDACTED]") if redacted else F.trim(F.substring(content, 1, 100))


def found_zones(topic: Column, raw: Column, zones: dict[str, str], low_topic: Column, low_raw: Column, ask=matches) -> dict[str, Column]:
    """For each zone whether a line has it; topic and raw are the code in the line and all of it, with its newline, and the
    others are their plain texts. ask tells of a text, its plain text, a pattern and flags whether the pattern is found."""
    out = {}
    for name, pattern in zones.items():
        test = ask(*((topic, low_topic) if name in TOPIC_ZONES else (raw, low_raw)), pattern, _flags(pattern))
        out[name] = test & ~matches(raw, low_raw, HASH_FIELD, EXACT) if name == "crypto" else test
    return out


def _with_texts(lines: DataFrame) -> DataFrame:
    """Adds _topic and _raw, the code in a line and all of it with its newline, and _low_topic and _low_raw, their plain texts."""
    topic, raw = F.concat(topic_text(F.col("path"), F.col("content")), F.lit("\n")), F.concat("content", F.lit("\n"))
    return lines.withColumns({"_topic": topic, "_raw": raw}).withColumns({"_low_topic": plain(F.col("_topic")), "_low_raw": plain(F.col("_raw"))})


def zone_hits(lines: DataFrame, zones: dict[str, str] = ZONES, redacted: bool = False) -> DataFrame:
    """One row for each added line of a file that isn't documentation and each zone found in it.

    Topic zones look at the code in a line, the others at all of it with its newline. A hash field takes back `crypto`.
    """
    added = _with_texts(lines.where(F.col("type") == "add").where(~is_doc(F.col("path"))))
    found = found_zones(F.col("_topic"), F.col("_raw"), zones, F.col("_low_topic"), F.col("_low_raw"))
    tests = [F.when(test, F.struct(F.lit(i).alias("zone_no"), F.lit(name).alias("zone"))) for i, (name, test) in enumerate(found.items())]
    hit = _found(added, tests)
    return hit.select("change_id", "file_no", F.col("path").alias("file"), F.col("line_number").alias("line"), "ord", "_hit.zone_no", "_hit.zone", preview(F.col("content"), redacted).alias("content_preview"))


# Our own secret rules: kind, pattern, severity, provable.
SECRETS = (
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "critical", True),
    ("cloud_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "critical", True),
    ("hardcoded_credential", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\s*[:=]\s*["'][^"']{8,}["']""", "high", False),
)


def secret_hits(lines: DataFrame, rules=SECRETS) -> DataFrame:
    """One row for each added line, of any file, and each rule found in it; hash fields are no secrets."""
    tests = [F.when(F.col("content").rlike(p), F.struct(F.lit(i).alias("kind_no"), F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(v).alias("provable"))) for i, (k, p, s, v) in enumerate(rules)]
    added = lines.where((F.col("type") == "add") & ~matches(F.col("content"), plain(F.col("content")), HASH_FIELD, EXACT))
    hit = _found(added, tests)
    return hit.select("change_id", "file_no", F.col("path").alias("file"), F.col("line_number").alias("line"), "ord", F.lit("entropy_secret").alias("zone"), "_hit.kind_no", "_hit.kind", "_hit.severity", "_hit.provable", F.lit("[REDACTED]").alias("content_preview"))


def scan_once(changes: DataFrame, keep, zones: dict[str, str] = ZONES, rules=SECRETS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """change_id, diff -> the zone hits and secret hits without their previews, the changed files and the totals by marks of all
    changes, as zone_hits, secret_hits, changed_files and fallback_totals give them: each diff is parsed and each line scanned
    once, whatever uses the four. keep writes a table and reads it again; it gets few rows, and no text of lines.
    """
    none = lambda kind: F.lit(None).cast(kind)
    totals = marks(F.col("diff"))
    kind = changes.select(totals.alias("m")).schema["m"].dataType.simpleString()
    row = lambda l=none(LINE), f=none(FILE), m=none(kind): F.struct(l.alias("l"), f.alias("f"), m.alias("m"))
    listed = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    each = changes.select("change_id", parsed(F.col("diff")).alias("_p"), totals.alias("_m"))
    parts = F.concat(F.transform(listed(F.col("_p.lines"), LINE), lambda l: row(l=l)), F.transform(listed(F.col("_p.files"), FILE), lambda f: row(f=f)), F.array(row(m=F.col("_m"))))
    rows = each.select("change_id", F.explode(parts).alias("_r")).select("change_id", "_r.l.file_no", "_r.l.path", "_r.l.line_number", "_r.l.ord", "_r.l.type", "_r.l.content", "_r.f", "_r.m")
    rows = _with_texts(rows.where("type = 'add' or type is null"))
    hit = lambda source, no=0, name=None, severity=None, provable=None: F.struct(F.lit(source).alias("source"), F.lit(no).alias("no"), F.lit(name).cast("string").alias("name"), F.lit(severity).cast("string").alias("severity"), F.lit(provable).cast("boolean").alias("provable"))
    # The code in a line is a part of it, so a plain text of either is in the line, but for one with a newline.
    texts = {p: own for p in (*zones.values(), *(p for _, p, _, _ in rules)) if (own := openers(p)) and "\n" not in "".join(own)}
    bit = {p: 1 << i for i, p in enumerate([*texts][:63])}
    rows = rows.withColumn("_bits", possible(F.col("_low_raw"), [texts[p] for p in bit]))
    ask = lambda text, low, p, flags: (F.col("_bits").bitwiseAND(F.lit(bit[p]).cast("long")) != 0) & text.rlike(flags + p) if p in bit else text.rlike(flags + p)
    code, secret = ~is_doc(F.col("path")), ~matches(F.col("content"), F.col("_low_raw"), HASH_FIELD, EXACT)
    found = found_zones(F.col("_topic"), F.col("_raw"), zones, F.col("_low_topic"), F.col("_low_raw"), ask)
    tests = [F.when(test & code, hit("zone", i, name)) for i, (name, test) in enumerate(found.items())]
    tests += [F.when(ask(F.col("content"), None, p, "") & secret, hit("secret", i, k, s, v)) for i, (k, p, s, v) in enumerate(rules)]
    tests += [F.when(F.col("f").isNotNull(), hit("file")), F.when(F.col("type").isNull() & F.col("f").isNull(), hit("totals"))]
    kept = keep(_found(rows, tests).select("change_id", "_hit.*", "file_no", F.col("path").alias("file"), F.col("line_number").alias("line"), "ord", "f", "m"))
    of = lambda source, *columns: kept.where(F.col("source") == source).select("change_id", *columns)
    place = ("file_no", "file", "line", "ord")
    return (
        of("zone", *place, F.col("no").alias("zone_no"), F.col("name").alias("zone")),
        of("secret", *place, F.lit("entropy_secret").alias("zone"), F.col("no").alias("kind_no"), F.col("name").alias("kind"), "severity", "provable"),
        of("file", "f.*"), of("totals", "m.*"),
    )


#: A token that may be random: its characters, and the least length and bits a character that make it a secret, for tokens
#: of hexadecimal digits and for others, which must mix letters and digits.
TOKEN = "[A-Za-z0-9+/=_-]{20,}"
HEX_LEAST, ANY_LEAST = (32, 3.0), (20, 4.0)
#: Lengths of commit ids and digests in hexadecimal digits, which are no secrets.
DIGESTS = (40, 64)


def entropy(token: Column) -> Column:
    """Shannon's entropy of a token in bits a character, from its histogram of characters; 0 for an empty one."""

    def over(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: let(share(c), lambda p: a - p * F.log2(p)))

    return F.when(F.length(token) > 0, let(F.filter(F.split(token, ""), lambda c: c != ""), over)).otherwise(0.0)


def entropy_hits(lines: DataFrame) -> DataFrame:
    """change_id, file, line, ord, token_no (from 0), length, bits: tokens of added lines that look random. Lines with a hash
    field have none, nor do tokens as long as a commit id or digest."""
    added = lines.where((F.col("type") == "add") & F.col("content").rlike(TOKEN) & ~F.col("content").rlike(EXACT + HASH_FIELD))
    each = added.select("change_id", F.col("path").alias("file"), F.col("line_number").alias("line"), "ord", F.posexplode(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0))).alias("token_no", "_t"))
    hexes = F.col("_t").rlike("^[0-9A-Fa-f]+$")
    likely = F.when(hexes, (F.length("_t") >= HEX_LEAST[0]) & ~F.length("_t").isin(*DIGESTS)).otherwise((F.length("_t") >= ANY_LEAST[0]) & F.col("_t").rlike("[A-Za-z]") & F.col("_t").rlike("[0-9]"))
    rows = each.where(likely).withColumn("bits", entropy(F.col("_t")))
    return rows.where(F.col("bits") >= F.when(hexes, HEX_LEAST[1]).otherwise(ANY_LEAST[1])).select("change_id", "file", "line", "ord", "token_no", F.length("_t").alias("length"), "bits")


def rubric_findings(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """The first changed line of each file that each rule matches, or the file's path.

    rules: dicts of id, severity, message, patterns and exceptions (globs in which * crosses /). A test file's findings
    are info. The first line comes from min_by, so files of any length only send one row a rule and task.
    """
    where = []
    for no, rule in enumerate(rules):
        excepted = F.lit(False)
        for glob in rule.get("exceptions", ()):
            excepted = excepted | F.col("path").rlike("^" + fnmatch.translate(glob).replace(r"\z", "").replace(r"\Z", "") + "$")
        hit = F.lit(False)
        at_path = F.lit(False)
        for p in rule["patterns"]:
            hit = hit | F.col("content").rlike("(?iuUd)" + p)
            at_path = at_path | F.col("path").rlike("(?iuUd)" + p)
        at = F.when(hit & F.col("type").isin("add", "remove"), F.struct(F.lit(no).alias("no"), F.col("ord").alias("at"), F.col("line_number").alias("line")))
        by_path = F.when(at_path, F.struct(F.lit(no).alias("no"), F.lit(2**31 - 1).alias("at"), F.lit(None).cast("int").alias("line")))
        where.append(F.when(~excepted, F.coalesce(at, by_path)))
    each = _found(lines, where)
    first = each.groupBy("change_id", "file_no", "path", F.col("_hit.no").alias("rule_no")).agg(F.min_by(F.col("_hit.line"), F.col("_hit.at")).alias("line"))
    column = lambda key: F.get(F.array(*[F.lit(r[key]) for r in rules]), F.col("rule_no"))
    return first.select("change_id", "file_no", F.col("path").alias("file"), "line", "rule_no", column("id").alias("rule_id"), F.when(is_test(F.col("path")), "info").otherwise(severity(column("severity"))).alias("severity"), column("message").alias("message"))


def merge_zones(*sources: DataFrame) -> DataFrame:
    """Rows of change_id, zone, file, line, content_preview from all sources; of equal ones the first source's stays."""
    rows = None
    for i, s in enumerate(sources):
        own = s.select("change_id", "zone", "file", "line", "content_preview").withColumn("source_no", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("change_id", "zone", "file", "line", "content_preview").agg(F.min("source_no").alias("source_no"))


def hmac_sha256(key: str, text: Column) -> Column:
    """HMAC-SHA256 in hex with a key of up to 64 bytes, from nested hashes."""
    raw = key.encode().ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in raw)), F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in raw)), F.unhex(inner)), 256)


# Our own redaction rules; a token that is only a hash or a commit id stays.
REDACTIONS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("quoted_token", r"\"[0-9a-f]{32,64}\""))
SAFE = (r"^[0-9a-f]{64}$", r"^[0-9a-f]{40}$", r"^sha256:[0-9a-f]{64}$")


def redact(df: DataFrame, column: str, salt: str, rules=REDACTIONS, safe=SAFE) -> DataFrame:
    """Adds <column>_redacted, redactions (distinct values by kind) and changed. Equal values get equal marks under one salt."""
    text = F.coalesce(F.col(column), F.lit(""))
    out, kept = _redacted(text, salt, rules, safe)
    counts = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in rules]), F.array(*[F.size(v) for v in kept]))
    return df.withColumns({f"{column}_redacted": out, "redactions": counts, "changed": out != text})


def _redacted(text: Column, salt: str, rules, safe) -> tuple[Column, list[Column]]:
    """The text with marks, and the values that each rule found and no safe pattern spares."""
    found = [F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for _, p in rules]
    kept = [F.filter(values, lambda v: ~_any(v, safe)) for values in found]
    out = text
    for values in kept:
        out = F.aggregate(values, out, lambda t, v: F.replace(t, v, F.concat(F.lit("[HIDDEN:"), F.substring(hmac_sha256(salt, v), 1, 12), F.lit("]"))))
    return out, kept


# Names of fields that hold hashes and signatures, by ending and whole.
HASH_ENDS = ("_hash",)
HASH_NAMES = ("signature_value", "public_key_id", "root_hash", "chain_hash", "previous_hash", "final_hash")


def redact_record(df: DataFrame, column: str, salt: str, rules=REDACTIONS, safe=()) -> DataFrame:
    """df with every string in a struct column redacted, in nested structs and arrays too, but those in fields that are
    named as hashes: these come back as they were, whatever the rules say."""

    def walk(value: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            fields = [(value[f.name] if f.name in HASH_NAMES or f.name.endswith(HASH_ENDS) else walk(value[f.name], f.dataType)).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: walk(x, kind.elementType))
        return _redacted(value, salt, rules, safe)[0] if isinstance(kind, StringType) else value

    return df.withColumn(column, walk(F.col(column), df.schema[column].dataType))


def _any(value: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def redactions_by_type(detections: DataFrame) -> DataFrame:
    """change_id, type, category, label -> change_id, kind, n: the first of the three that is neither null nor empty, else
    unknown."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    kind = F.coalesce(given("type"), given("category"), given("label"), F.lit("unknown"))
    return detections.groupBy("change_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def reported_redactions(reports: DataFrame) -> DataFrame:
    """change_id, kind, n from a service's reports: change_id, redactions_by_type (map of kind and count, as text) and
    redactions (array of structs with type, category and label). A map that is there counts, an empty one too; of it what
    is no whole number is skipped, and parts of one are cut off. Else the listed redactions are counted by kind."""
    whole = F.when(F.col("v").rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), F.trim("v").cast("long")).when(F.col("v").rlike(r"^[+-]?[0-9]{1,15}\.[0-9]*$"), F.regexp_extract("v", r"^([^.]*)", 1).cast("long"))
    mapped = reports.where("redactions_by_type is not null").select("change_id", F.explode("redactions_by_type").alias("kind", "v")).select("change_id", "kind", whole.alias("n")).where("n is not null")
    listed = reports.where("redactions_by_type is null").select("change_id", F.explode("redactions").alias("r")).select("change_id", "r.type", "r.category", "r.label")
    return mapped.unionByName(redactions_by_type(listed))


# Words of a detection's label by the zone that they stand for, in order.
LABEL_WORDS = {
    "pii": ("email", "phone", "ssn", "pii", "phi", "personal"),
    "payment": ("card", "pan", "payment", "billing"),
    "entropy_secret": ("secret", "token", "credential", "password", "key", "entropy"),
}


def label_zone(label: Column) -> Column:
    """The zone of a detection label by its words between spaces, hyphens and underscores; null for other labels."""
    words = F.split(F.lower(F.trim(label)), "[-_ ]")
    out = None
    for zone, names in LABEL_WORDS.items():
        test = F.arrays_overlap(words, F.array(*map(F.lit, names)))
        out = F.when(test, zone) if out is None else out.when(test, zone)
    return out


def pii_signals(detections: DataFrame, counts: DataFrame) -> DataFrame:
    """change_id, zone, file, line, category, content_preview, count from a redaction service's detections.

    detections has change_id, seq and the strings type, category, label, name, file, path, line, line_number, start_line,
    text, value, token: of each group the first that is neither null nor empty counts, of the lines the first whole number
    but 0. Changes without a detection in a zone get one signal for each kind of counts (change_id, kind, n). Of equal ones
    the first stays.
    """
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    number = lambda n: F.nullif(F.when(F.col(n).rlike(r"^\s*[+-]?[0-9]{1,9}\s*$"), F.trim(n).cast("int")), F.lit(0))
    own = detections.withColumn("category_", F.coalesce(first("type", "category", "label", "name"), F.lit("unknown")))
    own = own.withColumn("zone", label_zone(F.col("category_"))).where("zone is not null")
    own = own.select("change_id", "seq", "zone", F.coalesce(first("file", "path"), F.lit("__pii_shield__")).alias("file"), F.coalesce(*map(number, ("line", "line_number", "start_line"))).alias("line"), F.col("category_").alias("category"), F.substring(F.coalesce(first("text", "value", "token"), F.lit("")), 1, 120).alias("content_preview"), F.lit(None).cast("long").alias("count"))
    rest = counts.join(own.select("change_id").distinct(), "change_id", "left_anti").withColumn("zone", label_zone(F.col("kind"))).where("zone is not null")
    rest = rest.select("change_id", F.lit(0).cast("long").alias("seq"), "zone", F.lit("__pii_shield__").alias("file"), F.lit(None).cast("int").alias("line"), F.col("kind").alias("category"), F.lit("").alias("content_preview"), F.col("n").cast("long").alias("count"))
    keys = ("change_id", "zone", "file", "line", "category", "content_preview")
    return own.unionByName(rest).groupBy(*keys).agg(F.min_by("count", "seq").alias("count"))


def sanitization_summary(stages: DataFrame) -> DataFrame:
    """change_id, redaction_count, applied_to, status from change_id, stage_no, stage, redaction_count, changed.

    Stages are named once, in the order of their first number. Any change makes the status sanitized; redactions without
    one partial; else it is none. redaction_totals has the counts by kind.
    """
    by_stage = stages.groupBy("change_id", "stage").agg(F.min("stage_no").alias("_no"), F.sum(F.greatest("redaction_count", F.lit(0))).alias("_n"), F.bool_or("changed").alias("_changed"), F.bool_or(F.col("redaction_count") > 0).alias("_some"))
    g = by_stage.groupBy("change_id").agg(F.sum("_n").alias("redaction_count"), F.transform(F.array_sort(F.collect_list(F.struct("_no", "stage"))), lambda x: x["stage"]).alias("applied_to"), F.bool_or("_changed").alias("_changed"), F.bool_or("_some").alias("_some"))
    return g.select("change_id", "redaction_count", "applied_to", F.when(F.col("_changed"), "sanitized").when(F.col("_some"), "partial").otherwise("none").alias("status"))


def redaction_totals(stages: DataFrame) -> DataFrame:
    """change_id, kind, n: the counts of all stages (change_id, redactions: a map of kind and count) by kind."""
    return stages.select("change_id", F.explode("redactions").alias("kind", "n")).groupBy("change_id", "kind").agg(F.sum("n").alias("n"))


def trigger_hits(artifacts: DataFrame, pack: list[dict]) -> DataFrame:
    """artifact_id, text -> artifact_id, trigger, category, level for each trigger whose keyword or pattern is found.

    pack: dicts of trigger, category, level, and keywords (whole words, any case) or a pattern.
    """
    tests = []
    for t in pack:
        pattern = t.get("pattern") or r"\b(?:" + "|".join(rf"\Q{k}\E" for k in t["keywords"]) + r")\b"
        tests.append(F.when(F.col("text").rlike("(?iuUd)" + pattern), F.struct(F.lit(t["trigger"]).alias("trigger"), F.lit(t["category"]).alias("category"), F.lit(t["level"]).alias("level"))))
    return _found(artifacts, tests).select("artifact_id", "_hit.*")


def band(df: DataFrame, score: str, bands: list[tuple[float, float, str]]) -> DataFrame:
    """Adds `band`: the label of the range (both ends within) that holds the score; the ranges are literals of the plan."""
    out = None
    for low, high, name in bands:
        test = F.col(score).between(low, high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return df.withColumn("band", out)


def control_themes(hits: DataFrame, themes: dict[str, list[str]]) -> DataFrame:
    """trigger hits -> artifact_id, category, theme, by a literal map of each category's themes."""
    pairs = literal_map({k: "\n".join(v) for k, v in themes.items()})
    return hits.select("artifact_id", "category").distinct().withColumn("theme", F.explode(F.split(pairs[F.col("category")], "\n")))
