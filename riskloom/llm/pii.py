"""Personal data by fixed patterns and by bootstrapped contextual extraction, in DataFrame operations only.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers. These are the seeds of a bootstrap: the words
before an entity are a lexical pattern, and every other identifier-like token (letters and digits, three digits or more)
stands in a pattern of its own. Rounds of joins and sums over the graph of patterns and instances trust a pattern once
enough of its distinct instances are known, and then every instance of a trusted pattern; at the end, tokens in trusted
patterns that the fixed kinds don't cover are found too, as kind `id`.

A row is known by its doc_id and the hash of its text: rows that repeat both are one case with one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import cut, named, whole_row

#: The kinds in their fixed order; the last is the one that bootstrapping adds.
KINDS = ("email", "ip", "card", "phone", "id")
OTHER = 4
#: Java patterns with the matches that the contract's have. Runs are possessive, and a match starts where a run or the
#: search does, so that no run is searched twice. A card's pattern asks for the least number of digits at once. A token
#: of any length has a digit after letters and single hyphens, and six characters; it starts after no hyphen of its own.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "id": r"(?<![A-Za-z0-9])(?<![A-Za-z0-9]-)(?=[A-Za-z]*+(?:-[A-Za-z]++)*+-?+[0-9])(?=[A-Za-z0-9](?:[A-Za-z0-9]|[-_./:](?=[A-Za-z0-9])){5})[A-Za-z0-9]++(?:[-_./:][A-Za-z0-9]++)*+",
}
#: A text without a match of these has none of the kind.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "id": "[0-9]"}
#: A pattern is trusted with so many known instances, and with such a share of all its instances known.
LEAST_KNOWN, LEAST_SHARE = 3, 0.5


def _hits(kind: int, text: Column) -> Column:
    """Every match of a kind with the number of characters since the one before, and the last of those characters."""
    name = KINDS[kind]
    found = F.arrays_zip(F.split(text, PATTERNS[name], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[name]), F.lit(0)).alias("m"))
    rows = F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), _before(x["gap"]).alias("before"), x["m"].alias("m")))
    return F.when(text.contains(GUARDS[name]) if name == "email" else text.rlike(GUARDS[name]), F.filter(rows, lambda x: x["m"].isNotNull()))


def _before(gap: Column) -> Column:
    """The last two words of a gap whole, and all that follows them, in reverse: read from there, no word is searched twice."""
    return F.regexp_extract(F.reverse(gap), r"^[^\p{L}]*+(?:\p{L}\S*+(?:\s++\S++)?+)?+", 0)


def _valid(kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    parts = F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(F.concat(F.lit("000"), p), F.lit(3)), F.lit("999")), F.lit(0)) <= 255))
    back = F.reverse(digits)
    twice = lambda i: F.substring(back, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(twice(i) > 9, twice(i) - 9).otherwise(twice(i)))
    luhn = F.length(digits).between(12, 19) & (total % 10 == 0)
    return F.when(kind == 0, True).when(kind == 1, parts).when(kind == 2, luhn).when(kind == 3, F.length(digits).between(9, 15)).otherwise(F.length(digits) >= 3)


def scan(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, hits): doc_id and _h for each row of docs; and doc_id, _h, base and ids for each distinct one with a match.

    base holds the valid matches of the fixed kinds in order of start and kind, ids the other tokens that meet none of
    them: structs of start, kind, end, value and patterns. Starts and ends count code points from 0, ends exclusive;
    matches of one kind are leftmost and don't overlap.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select("doc_id", text.alias("_t")).select("doc_id", F.xxhash64("_t").alias("_h"), *[_hits(k, F.col("_t")).alias(f"_{k}") for k in range(len(KINDS))])
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,before:string,m:string>>")
    rows = cut(d.select("doc_id", "_h", F.flatten(F.array(*[F.coalesce(f"_{k}", none) for k in range(len(KINDS))])).alias("_found")), "pii-scan")
    each = rows.where(F.size("_found") > 0).select("doc_id", "_h", F.explode("_found").alias("x")).select("doc_id", "_h", "x.*").dropDuplicates(["doc_id", "_h", "kind", "i"])
    end = F.sum((F.col("gap") + F.length("m")).cast("long")).over(Window.partitionBy("doc_id", "_h", "kind").orderBy("i"))
    hits = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("m")).where(_valid(F.col("kind"), F.col("m")))
    hit = F.struct("start", "kind", "end", F.col("m").alias("value"), _patterns().alias("patterns"))
    own = hits.groupBy("doc_id", "_h").agg(F.array_sort(F.collect_list(F.when(F.col("kind") < OTHER, hit))).alias("base"), F.array_sort(F.collect_list(F.when(F.col("kind") == OTHER, hit))).alias("_ids"))
    clear = F.filter("_ids", lambda x: ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return rows.select("doc_id", "_h"), cut(own.select("doc_id", "_h", "base", clear.alias("ids")), "pii-hits")


def _patterns() -> Column:
    """The lexical patterns that a match stands in: the two words before it with the marks between them, and, if marks
    stand between it and the last word (a label), that word with its marks; in lower case with digits as 0."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]", "0"), r"\s+", " "))
    two = plain(F.reverse(F.regexp_extract("before", r"^[^\p{L}]*+\p{L}\S*+\s++[^\s\p{L}]*+\p{L}\S*+", 0)))
    marks = F.reverse(F.regexp_extract("before", r"^[^\p{L}]*+", 0))
    label = F.when(marks.rlike(r"^[^\s:=#]*+\s*+[:=#]"), plain(F.reverse(F.regexp_extract("before", r"^[^\p{L}]*+\p{L}\S*+", 0)))).otherwise("")
    return F.array_distinct(F.array_except(F.array(two, label), F.array(F.lit(""))))


def bootstrap(hits: DataFrame, least_known: int = LEAST_KNOWN, least_share: float = LEAST_SHARE) -> DataFrame:
    """pattern, known, total: the trusted patterns, learned from all hits.

    The graph has an edge for each distinct pair of pattern and instance. A round counts, for each pattern, its known
    instances and all, trusts it at least_known and least_share, and makes all instances of trusted patterns known.
    Rounds end when nothing new is known; each is written to the shared folder. Every step is a sum by key or a join that
    skew handling can split.
    """
    each = hits.select(F.explode(F.concat("base", "ids")).alias("x")).select("x.value", (F.col("x.kind") < OTHER).alias("seed"), F.explode("x.patterns").alias("pattern"))
    edges = cut(each.groupBy("pattern", "value").agg(F.bool_or("seed").alias("seed")), "pii-edges")
    known, n = edges.where("seed").select("value").distinct(), -1
    while True:
        marked = edges.join(known.select(F.col("value").alias("_v"), F.lit(1).alias("_k")), F.col("value") == F.col("_v"), "left")
        counts = marked.groupBy("pattern").agg(F.sum(F.coalesce("_k", F.lit(0))).alias("known"), F.count("*").alias("total"))
        trusted = cut(counts.where((F.col("known") >= least_known) & (F.col("known") >= least_share * F.col("total"))), "pii-patterns")
        fresh = edges.join(trusted.select("pattern"), "pattern", "left_semi").select("value")
        known = cut(known.select("value").union(fresh).distinct(), "pii-known")
        if (now := known.count()) == n:
            return trusted
        n = now


def find(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows as in scan; spans has doc_id, _h, base and spans (arrays of start, kind, end in order) for each
    row of docs with a match. Base spans always stay; tokens in a trusted pattern that meet none of them are added."""
    rows, hits = scan(docs, text_col)
    trusted = bootstrap(hits)
    span = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    tokens = hits.where(F.size("ids") > 0).select("doc_id", "_h", F.explode("ids").alias("x")).select("doc_id", "_h", span(F.col("x")).alias("x"), F.explode("x.patterns").alias("pattern"))
    more = tokens.join(trusted.select("pattern"), "pattern", "left_semi").groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash")).agg(F.collect_set("x").alias("_more"))
    j = hits.select("doc_id", "_h", F.transform("base", span).alias("base")).join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    return rows, j.select("doc_id", "_h", "base", F.when(F.col("_more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "_more"))).alias("spans"))


def told(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_id, base_sha256 and spans for every row of docs; null texts have no finds."""
    rows, spans = find(docs, text_col)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    same = rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["_h"] == spans["_h"])
    j = rows.join(spans, same, "left").select(rows["doc_id"], F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("_all"))

    def count(k: int) -> Column:
        return F.size(F.filter("_all", lambda s: s["kind"] == k)).cast("long")

    n = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return j.select("doc_id", *n, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("_all")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """docs with each found span replaced by its kind; spans that overlap are replaced together, by the first one's kind.

    A null text stays null, and the columns are those of docs, whatever their names.
    """
    _, spans = find(docs, text_col)
    names = F.array(*[F.lit(mark.format(k.upper())) for k in KINDS])
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash"), F.col("spans").alias("_spans"))
    d = docs.select(whole_row(docs), named("doc_id")[0].alias("_own"), named(text_col)[0].alias("_t")).withColumn("_h", F.xxhash64(F.coalesce("_t", F.lit(""))))
    j = d.join(spans, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    # Overlapping spans merge; then the text is what lies between, and the marks.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    part = lambda a, b: F.substring(F.col("_t"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], part(acc["at"], s["start"]), F.get(names, s["kind"])).alias("out")))
    text = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_t"), (acc["at"] + 1).cast("int"), F.length("_t"))))
    j = j.select("_row", F.when(F.size("_spans") > 0, text).otherwise(F.col("_t")).alias("_new"))
    return j.select(*[(F.col("_new") if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])
