"""Plans and shapes that keep a query's cost in proportion to its input."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from riskloom import config
from riskloom import functions as fn
from riskloom.operators import evidence, lines, origins, scans, votes
from riskloom.plans import inputs, queries


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_diffs_of_prompts_are_not_broadcast(spark):
    reviews = spark.range(40).select((F.col("id") % 20).alias("change_id"), F.col("id").alias("voter_no"), F.lit("v").alias("voter"), F.lit("approve").alias("risk_assessment"), F.lit(0.5).alias("confidence"), F.array(F.lit("c")).alias("concerns"))
    diffs = spark.range(10).select(F.col("id").alias("change_id"), F.repeat(F.lit("-x\n"), F.col("id").cast("int")).alias("diff"))
    got = votes.crosscheck_prompts(reviews, diffs)
    assert "BroadcastHashJoin" not in executed(got) and "SortMergeJoin" in executed(got)
    assert got.count() == 40 and got.where(F.col("prompt").contains("Diff:\n-x\n-x\nAgree")).count() == 0
    assert got.where(F.col("prompt").contains("Diff:\n-x\n-x\n\nAgree")).count() == 2


def test_lines_in_ranges_are_counted_once_without_a_distinct_count(spark):
    ranges = spark.createDataFrame([(1, "a", 1, 9), (1, "a", 5, 600), (1, "a", 590, 595), (1, "b", 4, 4), (2, "a", 600, 700), (3, "a", 9, 3)], "change_id long, path string, start long, end long")
    blame = spark.createDataFrame([(p, n, s, t) for p in "ab" for n in range(1, 651) for s, t in ((f"s{n % 2}", n), (f"s{n % 2}", n + 1), ("s0", 7))], "path string, line_no long, sha string, commit_date long")
    got = origins.candidates(ranges, blame)
    assert "distinct" not in executed(got)
    assert sorted(map(tuple, got.collect())) == [(1, "s0", 601, 2), (1, "s1", 300, 1), (2, "s0", 51, 7), (2, "s1", 25, 601)]


def test_patterns_are_asked_only_where_a_plain_text_of_theirs_is(spark):
    assert scans.needed("(auth|api.?key|DES\\b)") == ["auth", "api", "des"] and scans.needed("abc?d{2}") == ["ab"]
    assert scans.needed("a|bcd") == scans.needed("(?i)abc") == scans.needed(r"\x41bc") == scans.needed(r"\d+") == []
    texts = ["API_Key", "toKen", "admİn", "admın", "ſql", "sha1x", "sha12", "nothing", "", None, "Social-Security", "shell = True"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in config.ZONES.values():
        flags = scans._flags(pattern)
        got = df.select("t", scans.matches(F.col("t"), scans.plain(F.col("t")), pattern, flags).alias("got"), F.col("t").rlike(flags + pattern).alias("want"))
        assert got.where("not (got <=> want)").count() == 0


def test_parts_are_parsed_on_all_cores_and_the_fold_holds_no_lines(spark):
    assert inputs.mixed_changes(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "content" not in lines._BODY and "lines" not in lines._STATE
    body = "".join(f"+{i}\n" for i in range(200))
    diff = f"diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,203 @@\n c\n{body}-gone\n+++ plus\n+ end\nafter"
    got = lines.diff_lines(spark.createDataFrame([(1, diff)], "change_id long, diff string")).orderBy("ord").collect()
    assert len(got) == 204 and [(r.type, r.content, r.line_number) for r in got[-3:]] == [("remove", "gone", 2), ("add", "++ plus", 202), ("add", " end", 203)]


def test_whole_numbers_and_strings_are_written_by_the_native_json(spark):
    """The native way gives the long way's text, and takes that where it would differ."""
    df = spark.sql(r"select named_struct('z', c, 'a', array(named_struct('y', c, 'x', 1), null), 'n', cast(null as array<string>)) as v from values ('a\u000bb'), (char(27)), ('\"\\\\u00/\n'), ('é '), (null), (''), (cast(x'61ff' as string)) t(c)")
    kind = df.schema["v"].dataType
    native, plain = fn.canonical("v", kind), fn.canonical("v", kind, native=False)
    assert native.count("to_json") == 1 and "to_json" not in plain
    got = df.select(F.expr(native).cast("binary").alias("got"), F.expr(plain).cast("binary").alias("want"))
    assert got.where("not (got <=> want)").count() == 0 and got.where("want is not null").count() == 7


def test_folds_over_events_hold_hashes_only_and_bind_without_taking_an_element(spark):
    kinds = spark.createDataFrame([], "event_type string, timestamp string, actor string, data string").schema
    assert evidence.chain_hashes("events", kinds).startswith("aggregate(events, cast(array() as array<string>)")
    df = spark.range(3).select(fn.let(F.col("id") + 1, lambda v: F.struct(v.alias("a"), F.when(v > 1, v).alias("b"))).alias("s"))
    assert "[0]" not in executed(df) and "transform" not in executed(df)
    assert [tuple(r.s) for r in df.collect()] == [(1, None), (2, 2), (3, 3)]


def test_documents_of_one_row_group_are_dealt_to_all_parts(spark, tmp_path):
    """A file of one row group is read in many parts, all but one of them empty."""
    path = str(tmp_path / "documents.parquet")
    spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    read = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert sum(n > 0 for n in spark.read.parquet(path).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) == 1
        got = inputs.code(spark, str(tmp_path)).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", read)
    assert sum(got) == 4000 and len(got) > 4 and max(got) < 1000


def test_summaries_parse_and_scan_each_diff_once(spark):
    """Hits, secrets, files and totals come from a kept table: the plan that joins them reads no text and asks no zone's pattern."""
    got = queries.QUERIES["f7_summaries"](spark, "/root/testdata/sf0.001")
    assert "text" not in " ".join(re.findall(r"ReadSchema: (.*)", got._jdf.queryExecution().toString())) and config.ZONES["xss"] not in executed(got)
    rows = []
    scans.scan_once(inputs.changes(spark, "/root/testdata/sf0.001"), lambda df: rows.append(df) or df)
    assert executed(rows[0]).count("FileScan") == 1 and executed(rows[0]).count(config.ZONES["xss"]) == 1


def test_one_scan_gives_the_rows_of_the_four_operators(spark):
    file = lambda path, *added: f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1,1 +1,{len(added)} @@\n-token = old\n" + "\n".join("+" + x for x in added)
    secret, noise = 'password = "hunter2hunter2"', f'content_hash = "{"ab" * 32}" token = "0123456789"'
    diffs = [
        file("src/a.py", "exec(sql) # login", secret, "AKIA" + "A1" * 8, noise, "-----BEGIN RSA PRIVATE KEY-----"), file("docs/a.md", "login", secret), file("tests/a.js", "eval(x) // token", secret, secret) + "\n" + file("conf/a.yml", "aws: email", "plain"),
        file("src/b.py", "login", "cut")[:-8], "@@ nothing\n+login", "+login\n-gone\n+++ x", "diff --git a/x.png b/y.png\nrename from x.png\nrename to y.png", "", None, "no diff",
    ]
    changes = spark.createDataFrame([*enumerate(diffs), (0, diffs[2]), (None, diffs[0])], "change_id long, diff string")
    each = lines.diff_lines(changes)
    want = (scans.zone_hits(each).drop("content_preview"), scans.secret_hits(each).drop("content_preview"), lines.changed_files(changes), lines.fallback_totals(changes))
    got = scans.scan_once(changes, lambda df: df)
    for g, w, least in zip(got, want, (10, 9, 9, 12)):
        assert g.columns == w.columns and g.count() >= least and g.exceptAll(w).count() == w.exceptAll(g).count() == 0


def test_secrets_are_asked_only_where_a_plain_text_of_theirs_is(spark):
    assert scans.openers("(?i)(?:ab|cd)?x") == scans.openers("(?:ab|cd)x|y") == scans.openers("(?s)abc") == [] and scans.openers("(?i)(?:abc?|d.ef)+x") == ["ab", "ef"]
    texts = ['PassWord = "12345678"', "api_key: '12345678'", 'apiKey="12345678"', 'toKen = "12345678"', 'token = "1234567"', "AKIA" + "A1" * 8, "akia" + "A1" * 8, "ASIA" + "0Z" * 8 + "x", "-----BEGIN PRIVATE KEY-----", "-----begin private key-----", "plain", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for _, pattern, _, _ in scans.SECRETS:
        assert scans.openers(pattern)
        got = df.select("t", scans.matches(F.col("t"), scans.plain(F.col("t")), pattern, "").alias("got"), F.col("t").rlike(pattern).alias("want"))
        assert got.where("not (got <=> want)").count() == 0 and got.where("want").count() > 0


def test_one_search_tells_which_plain_texts_a_line_holds(spark):
    texts = [scans.openers(p) for p in (*config.ZONES.values(), *(p for _, p, _, _ in scans.SECRETS))]
    assert all(texts)
    texts += [["a.b", "(c", "d e"], ["=-<"], ["\\"]] + [["zz"]] * 43
    values = [t + x for own in texts for t in own for x in ("", "y")] + ["axb c de", "", None, "x" * 200_000 + "shutil.", "é aws ü", "\nsql\n"]
    df = spark.createDataFrame([(v,) for v in values], "t string").unionByName(spark.sql("select cast(x'ff61757468fe' as string) as t"))
    want = sum((F.when(F.exists(F.array(*map(F.lit, own)), lambda x: F.col("t").contains(x)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, own in enumerate(texts)), F.lit(0).cast("long"))
    got = df.select("t", scans.possible(F.col("t"), texts).alias("got"), want.alias("want"))
    assert len(texts) == 63 and got.where("not (got <=> want)").count() == 0 and got.where("got > 0").count() > 120
