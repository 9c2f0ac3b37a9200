"""Tamper-evident evidence: event chains, proofs, sealed bundles and their verification, as folds over arrays in a row.

A bundle is one row: events, each with the hash of the chain up to it, items made of them, the proof that chains the items,
what is known of the change (context, summary, sanitization, analysis_snapshot), and a seal over the canonical JSON of all of
it. One shuffle gathers a bundle's events; all else is computed in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from riskloom.functions import canonical, uuid5_url

# The fields of an event that its hash covers, of a bundle that the seal covers, and those among them that a
# bundle without a seal must not have; and the versions that must be sealed.
EVENT = ("event_type", "timestamp", "actor", "data")
BUNDLE = ("version", "spec_version", "bundle_id", "created_at", "context", "events", "hash_chain", "items", "immutability_proof", "summary", "sanitization", "analysis_snapshot")
SEALED = ("items", "immutability_proof", "summary", "analysis_snapshot", "context", "sanitization")
VERSION, SEALED_VERSIONS = "0.2.0", "0.2"
STRING = StringType()


def number_events(events: DataFrame, order: list) -> DataFrame:
    """Adds sequence (from 0) within each bundle_id."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy("bundle_id").orderBy(*order)) - 1)


def _text(e: str, kinds: StructType, previous: str | None = None) -> str:
    """SQL of the canonical JSON of an event, with the hash before it if given."""
    fields = {c: (f"{e}.{c}", kinds[c].dataType) for c in EVENT} | ({"previous_hash": (previous, STRING)} if previous else {})
    whole = ", ".join(f"'{c}', {v}" for c, (v, _) in sorted(fields.items()))
    return canonical(f"named_struct({whole})", StructType([StructField(c, kind) for c, (_, kind) in sorted(fields.items())]))


def _fields(e: str, names: tuple[str, ...] = EVENT) -> str:
    return ", ".join(f"'{c}', {e}.{c}" for c in names)


def chain_hashes(events: str, kinds: StructType) -> str:
    """SQL of the hash of each event: it covers the event's canonical JSON with the hash before it; the first follows the empty
    string. The fold holds hashes only, since a function over arrays copies what it gives."""
    last = "coalesce(get(_a, size(_a) - 1), '')"
    return f"aggregate({events}, cast(array() as array<string>), (_a, _e) -> concat(_a, array(sha2({_text('_e', kinds, last)}, 256))))"


def hashed_events(events: str, hashes: str) -> Column:
    """Events with their hash, by the names of both columns."""
    return F.expr(f"transform({events}, (_e, _i) -> named_struct({_fields('_e')}, 'hash', {hashes}[_i]))")


def _gathered(events: DataFrame) -> tuple[DataFrame, StructType]:
    e = F.array_sort(F.collect_list(F.struct("sequence", *EVENT)))
    return events.groupBy("bundle_id").agg(e.alias("_e")), StructType([events.schema[c] for c in EVENT])


def event_chain(events: DataFrame) -> DataFrame:
    """bundle_id, sequence, event_type, timestamp, actor, data (of any type) -> bundle_id, event_count, events (with hash),
    final_hash."""
    rows, kinds = _gathered(events)
    rows = rows.select("bundle_id", "_e", F.expr(chain_hashes("_e", kinds)).alias("_h"))
    return rows.select("bundle_id", F.size("_e").alias("event_count"), hashed_events("_e", "_h").alias("events"), F.coalesce(F.get("_h", F.size("_h") - 1), F.lit("")).alias("final_hash"))


def item(e: str, i: str, kinds: StructType) -> str:
    """SQL of the item of a bundle that stands for event number i."""
    content = f"named_struct({_fields(e, tuple(sorted(EVENT)))})"
    number = f"if({i} between 0 and 9999, concat('event-', lpad(cast({i} as string), 4, '0')), format_string('event-%04d', {i}))"
    return f"named_struct('item_id', {number}, 'sequence', cast({i} as int), 'content_type', concat('riskloom/', {e}.event_type), 'content', {content}, 'content_hash', concat('sha256:', sha2({_text(e, kinds)}, 256)))"


def items(events: DataFrame) -> DataFrame:
    """bundle_id, item_id, sequence, content_type, content, content_hash: one item for each event."""
    kinds = StructType([events.schema[c] for c in EVENT])
    rows = events.select("bundle_id", "sequence", F.struct(*EVENT).alias("_e"))
    return rows.select("bundle_id", F.expr(item("_e", "sequence", kinds)).alias("_i")).select("bundle_id", "_i.*")


def proof(item_rows: DataFrame) -> DataFrame:
    """bundle_id, links (with previous_hash and chain_hash) and root_hash; the first link follows `genesis`."""
    g = item_rows.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "item_id", "content_type", "content_hash"))).alias("_i"))
    g = g.withColumn("_h", link_hashes(F.col("_i")))
    return g.select("bundle_id", chain_links(F.col("_i"), F.col("_h")).alias("links"), root_hash(F.col("_h")).alias("root_hash"))


def link_hashes(rows: Column) -> Column:
    """The chain hash of each item, as chain_hashes does it."""
    text = lambda x, last: F.concat_ws("|", x["sequence"].cast("string"), x["item_id"], x["content_type"], x["content_hash"], last)
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit("genesis"))
    return F.aggregate(rows, F.array().cast("array<string>"), lambda a, x: F.concat(a, F.array(F.concat(F.lit("sha256:"), F.sha2(text(x, last(a)), 256)))))


def chain_links(rows: Column, hashes: Column) -> Column:
    """Items with the hashes of the links before and at them."""
    link = lambda x, i: F.struct(x["sequence"].cast("int").alias("sequence"), x["item_id"].alias("item_id"), x["content_type"].alias("content_type"), x["content_hash"].alias("content_hash"), F.coalesce(F.get(hashes, i - 1), F.lit("genesis")).alias("previous_hash"), F.get(hashes, i).alias("chain_hash"))
    return F.transform(rows, link)


def root_hash(hashes: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(hashes, ""), 256))


def bundle_id(repository: Column, number: Column, commit: Column) -> Column:
    return uuid5_url(F.concat_ws("/", repository, F.lit("pull"), number.cast("string"), commit))


def zone_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("change_id", "zone").agg(F.count("*").alias("hits"), F.sort_array(F.collect_set("file")).alias("files"))


def _present(rows: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in names if c in rows.columns]


def _document(rows: DataFrame, names: tuple[str, ...]) -> Column:
    part = lambda c: f"if(`{c}` is null, null, concat('\"{c}\":', {canonical(f'`{c}`', rows.schema[c].dataType)}))"
    parts = ", ".join(part(c) for c in sorted(_present(rows, names)))
    return F.expr(f"concat('{{', concat_ws(',', {parts}), '}}')")


def seal_text(rows: DataFrame) -> Column:
    """What a bundle's seal covers: the canonical JSON of all of BUNDLE that the row has. A null field is one it hasn't."""
    return _document(rows, BUNDLE)


def seal(rows: DataFrame, strip_signatures: bool = False) -> DataFrame:
    """rows with bundle_hash over all of BUNDLE, and no signatures (array<string>): the last step, and to be taken again after
    any change, as redaction is. A row that carries signatures is an error unless they are to go."""
    text = seal_text(rows)
    if "signatures" in rows.columns and not strip_signatures:
        text = F.when(F.coalesce(F.size("signatures"), F.lit(0)) > 0, F.raise_error(F.lit("a new seal would void the bundle's signatures")).cast("string")).otherwise(text)
    return rows.withColumns({"bundle_hash": F.concat(F.lit("sha256:"), F.sha2(text, 256)), "signatures": F.array().cast("array<string>")})


def bundles(events: DataFrame, heads: DataFrame, version: str = VERSION) -> DataFrame:
    """One sealed row for each bundle_id of events: BUNDLE, bundle_hash and signatures (none).

    events: see event_chain. heads: bundle_id and any of created_at, context, summary, sanitization, analysis_snapshot, of any
    type; a bundle that isn't there has none of them.
    """
    chain = event_chain(events)
    kinds = StructType([events.schema[c] for c in EVENT])
    rows = chain.withColumn("items", F.expr(f"transform(events, (_v, _i) -> {item('_v', '_i', kinds)})")).withColumn("_links", link_hashes(F.col("items")))
    rows = rows.select(
        "bundle_id", F.lit(version).alias("version"), F.lit(version).alias("spec_version"), "events", F.struct(F.lit("sha256").alias("algorithm"), "final_hash", "event_count").alias("hash_chain"), "items",
        F.struct(chain_links(F.col("items"), F.col("_links")).alias("hash_chain"), root_hash(F.col("_links")).alias("root_hash")).alias("immutability_proof"),
    )
    rows = rows.join(heads, "bundle_id", "left")
    return seal(rows.select(*_present(rows, BUNDLE)))


def verify(rows: DataFrame) -> DataFrame:
    """bundle_id, valid, reason, first_bad for each bundle (columns of BUNDLE and bundle_hash; those that are missing or null
    are fields it hasn't).

    The event chain is computed again with the hashes that each event carries: first_bad is the first event, from 0, whose
    hash differs. Then the chain's end, and the seal. A bundle of a sealed version, or with any field of SEALED, an empty
    one too, must have its seal; only bare events may go without.
    """
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    kinds = rows.schema["events"].dataType.elementType
    rows = rows.withColumn("_walked", F.expr(chain_hashes("events", kinds)))
    walked = F.struct(F.coalesce(F.get("_walked", F.size("_walked") - 1), F.lit("")).alias("last"), F.expr("cast(nullif(array_position(zip_with(_walked, events, (_h, _e) -> _h <=> _e.hash), false), 0) - 1 as int)").alias("bad"))
    sealed = F.lit(False)
    for c in _present(rows, SEALED):
        sealed = sealed | F.col(c).isNotNull()
    for c in _present(rows, ("version", "spec_version")):
        sealed = sealed | F.coalesce(F.col(c).startswith(SEALED_VERSIONS), F.lit(False))
    end = F.col("hash_chain.final_hash") if "hash_chain" in rows.columns else F.lit("")
    b = rows.select("bundle_id", (F.coalesce(F.size("events"), F.lit(0)) <= 0).alias("_none"), walked.alias("_w"), F.coalesce(end, F.lit("")).alias("_end"), sealed.alias("_sealed"), F.nullif(has("bundle_hash").cast("string"), F.lit("")).alias("_hash"), F.concat(F.lit("sha256:"), F.sha2(seal_text(rows), 256)).alias("_seal"))
    reason = (
        F.when(F.col("_none"), "no events")
        .when(F.col("_w.bad").isNotNull(), "event hash differs")
        .when(F.col("_w.last") != F.col("_end"), "final hash differs")
        .when(F.col("_sealed") & F.col("_hash").isNull(), "seal is missing")
        .when(F.col("_hash") != F.col("_seal"), "seal differs")
    )
    return b.select("bundle_id", reason.isNull().alias("valid"), F.coalesce(reason, F.lit("ok")).alias("reason"), F.when(~F.col("_none"), F.col("_w.bad")).alias("first_bad"))


def verify_proof(rows: DataFrame) -> DataFrame:
    """bundle_id, valid, reason, first_bad: whether items are those of the events, and links and root those of the items;
    first_bad is the first sequence that differs. A seal shows whether these were changed, this shows which."""
    kinds = rows.schema["events"].dataType.elementType
    again = rows.select("bundle_id", "items", F.col("immutability_proof.hash_chain").alias("links"), F.col("immutability_proof.root_hash").alias("root"), F.expr(f"transform(events, (_v, _i) -> {item('_v', '_i', kinds)})").alias("_items"))
    again = again.withColumn("_h", link_hashes(F.col("_items"))).withColumn("_links", chain_links(F.col("_items"), F.col("_h")))
    first = lambda a, b: F.array_min(F.zip_with(a, b, lambda x, y: F.when(~x.eqNullSafe(y), F.coalesce(x["sequence"], y["sequence"]))))
    again = again.withColumns({"_i": first("items", "_items"), "_l": first("links", "_links")})
    reason = F.when(F.col("_i").isNotNull(), "item differs").when(F.col("_l").isNotNull(), "link differs").when(~F.col("root").eqNullSafe(root_hash(F.col("_h"))), "root differs")
    return again.select("bundle_id", reason.isNull().alias("valid"), F.coalesce(reason, F.lit("ok")).alias("reason"), F.coalesce("_i", "_l").alias("first_bad"))


def evidence_events(submitted: DataFrame, analysed: DataFrame, classified: DataFrame, approvals: DataFrame) -> DataFrame:
    """bundle_id, sequence, event_type, timestamp, actor, data: a change's events in their fixed order, approvals in the order
    of their number.

    submitted: bundle_id, created_at, actor, and the fields of data; analysed: bundle_id, created_at, ...; classified:
    bundle_id, created_at, ...; approvals: bundle_id, created_at, no, actor, .... data is the canonical JSON of the other columns.
    """

    def part(df: DataFrame, order: int, kind: str, actor: Column, but: tuple[str, ...]) -> DataFrame:
        own = [c for c in df.columns if c not in ("bundle_id", "created_at", *but)]
        no = F.col("no") if "no" in but else F.lit(0)
        listed = ", ".join(f"`{c}`" for c in own)
        data = F.expr(canonical(f"struct({listed})", StructType([df.schema[c] for c in own]))) if own else F.lit("{}")
        return df.select("bundle_id", F.struct(F.lit(order).alias("order"), no.cast("long").alias("no")).alias("_at"), F.lit(kind).alias("event_type"), F.col("created_at").alias("timestamp"), F.coalesce(actor, F.lit("unknown")).alias("actor"), data.alias("data"))

    tool = F.lit("riskloom")
    e = part(submitted, 0, "pr_submitted", F.col("actor"), ("actor",)).unionByName(part(analysed, 1, "analysis_completed", tool, ())).unionByName(part(classified, 2, "risk_classified", tool, ())).unionByName(part(approvals, 3, "approval_granted", F.col("actor"), ("actor", "no")))
    return number_events(e, ["_at"]).drop("_at")


def bundle_documents(rows: DataFrame) -> DataFrame:
    """bundle_id, document: the whole bundle as canonical JSON: all that the seal covers, the seal and the signatures."""
    return rows.select("bundle_id", _document(rows, (*BUNDLE, "bundle_hash", "signatures")).alias("document"))
