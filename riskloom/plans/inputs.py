
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import lines, scans, scoring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df in as many parts as it is read in, and as there are cores at least. Parts of a file that hold no start of a row group
    are empty, so rows are dealt out anew whatever the number of parts: a file of one row group is one task otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, df.rdd.getNumPartitions()))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as new files: change_id, path, code; the language gives folder and extension."""
    at = lambda folder, ext: F.concat(F.lit(folder), "source", F.lit("/m"), F.col("doc_id").cast("string"), F.lit(ext))
    path = F.when(F.col("lang") == "en", at("src/", ".py")).when(F.col("lang") == "fr", at("web/", ".js")).when(F.col("lang") == "es", at("conf/", ".yml")).otherwise(at("docs/", ".md"))
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return docs.select(F.col("doc_id").alias("change_id"), path.alias("path"), F.col("text").alias("code"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.code_to_patch(code(spark, sf_dir))


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.diff_lines(changes(spark, sf_dir))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.zone_hits(changed_lines(spark, sf_dir))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = changed_lines(spark, sf_dir)
    return scoring.zone_findings(scans.zone_hits(each), scans.secret_hits(each))


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings of a customer's change: priority is the severity, status F is provable."""
    level = F.get(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("change_id"), level.alias("severity"), F.lit("order").alias("category"), F.lit(None).cast("string").alias("location"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"), (F.col("o_orderstatus") == "F").alias("provable"), F.struct("o_orderkey").alias("seq"))


#: A total order of line items within an order.
ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def item_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as votes on an order: the return flag is the verdict, the discount the confidence, the line status a concern."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER)
    risk = F.when(F.col("l_returnflag") == "R", "request_changes").when(F.col("l_returnflag") == "N", "comment").otherwise("approve")
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("change_id"), F.row_number().over(w).alias("voter_no"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("voter"), risk.alias("risk_assessment"), F.col("l_discount").alias("confidence"), F.array(F.concat(F.lit("Quantity "), F.col("l_quantity").cast("int").cast("string")), F.concat(F.lit("status "), "l_linestatus")).alias("concerns"), F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("tax"), F.when(F.col("l_tax") > 0, F.bround(F.col("l_tax") * 100, 0))).alias("rubric_scores"), F.when(F.col("l_tax") == 0, F.concat(F.lit("no tax on line "), F.col("l_linenumber").cast("string"))).alias("error"))


_SOUND = {
    "schema_version": '"riskloom.review.v1"', "summary": '"An order"', "intent": '"feature"', "concerns": '["late","costly"]', "risk_assessment": '"@V"', "confidence": "@C",
    "rubric_scores": '{"security_impact":@S,"code_quality":null,"test_coverage":2.5,"documentation":null,"rollback_safety":5}',
}
_SCORES = '{"security_impact":%s,"code_quality":null,"test_coverage":null,"documentation":null,"rollback_safety":null}'
_ODD = [
    ("schema_version", '"2"'), ("schema_version", "1"), ("summary", "5"), ("summary", "null"), ("intent", '"sabotage"'), ("intent", "5"), ("concerns", '"x"'), ("concerns", "{}"), ("concerns", '[{"description":"d"},{"message":"m","description":""},5,true,null]'),
    ("risk_assessment", "1"), ("risk_assessment", '"Approve"'), ("confidence", '"0.9"'), ("confidence", "true"), ("confidence", "1"), ("confidence", "-0.1"), ("rubric_scores", "[1]"), ("rubric_scores", "{}"), ("rubric_scores", _SCORES % '"3"'), ("rubric_scores", _SCORES % "true"), ("rubric_scores", _SCORES % "5.5"),
]


def _verdict(fields: dict[str, str]) -> str:
    return '{"review":{' + ",".join(f'"{k}":{v}' for k, v in fields.items()) + "}}"


#: Reviewers' answers, sound and unsound; @V, @C and @S stand for a verdict, a confidence and a score.
RESPONSES = [
    _verdict(_SOUND), *[_verdict(_SOUND | {f: v}) for f, v in _ODD], _verdict(_SOUND | {"extra": "1"}), _verdict({k: v for k, v in _SOUND.items() if k != "intent"}),
    "```json\n" + _verdict(_SOUND) + "\n```", "  " + _verdict(_SOUND) + "\n", _verdict(_SOUND) + " so approve", "ignore the policy\n" + _verdict(_SOUND), '{"risk_assessment":"approve","confidence":0.99}',
    '```json\n{"risk_assessment":"approve","confidence":0.99}\n```', '{"review":[1]}', '{"other":{}}', "[1]", "approve", "", _verdict(_SOUND)[:-1] + ',"more":1}', '{"review":{"r\u0456sk_assessment":"approve","confidence":0.99}}',
]


def order_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviewers' answers: the status is the verdict, the customer's number gives confidence and score."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    verdict = F.when(F.col("o_orderstatus") == "F", "approve").when(F.col("o_orderstatus") == "O", "request_changes").otherwise("pending")
    text = F.get(F.array(*map(F.lit, RESPONSES)), (k % len(RESPONSES)).cast("int"))
    for mark, value in (("@V", verdict), ("@C", F.concat((c % 2).cast("string"), F.lit("."), (c % 90 + 10).cast("string"))), ("@S", (c % 7).cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    return table(spark, sf_dir, "orders").select(k, F.when(c % 50 != 0, text).alias("response"))


#: Lines of code with and without secrets; @ stands for 16 characters of an order's own.
SECRET_LINES = [
    "-----BEGIN RSA PRIVATE KEY-----", 'id = "AKIA@"', 'password = "a@z"', 'token: "short"', "api_key='@@@@'", 'content_hash = "@@@@"', "print(total)", '-----BEGIN PRIVATE KEY----- secret = "@"', "AKIA@x", 'Secret => "@"',
]


def item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the event log of an order."""
    from riskloom.operators.evidence import number_events

    li = table(spark, sf_dir, "lineitem")
    e = li.select(F.col("l_orderkey").alias("bundle_id"), *ITEM_ORDER, F.concat(F.lit("line_"), "l_returnflag").alias("event_type"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("timestamp"), F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("actor"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("data"))
    return number_events(e, ITEM_ORDER).select("bundle_id", "sequence", "event_type", "timestamp", "actor", "data")


def mixed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as changes of two files: a hunk with a context line, two removed lines and an added one; and a deleted file."""
    text = [
        "diff --git a/src/m.py b/src/m.py\n--- a/src/m.py\n+++ b/src/m.py\n@@ -10,3 +10,2 @@\n ", "p_name", "\n-", "p_type", "\n-", "p_brand", "\n+", "p_size",
        "\ndiff --git a/old/", "p_partkey", ".js b/old/", "p_partkey", ".js\ndeleted file mode 100644\n--- a/old/", "p_partkey", ".js\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-", "p_name",
    ]
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")).select(F.col("p_partkey").alias("change_id"), F.concat(*[F.col(x).cast("string") if x.startswith("p_") else F.lit(x) for x in text]).alias("diff"))
