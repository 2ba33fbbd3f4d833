"""The audit trail: entry hashes, chains and their verification, receipts, Merkle checkpoints, anchoring."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
V1, V2 = "audit-v1", "audit-v2-canonical-json"
#: The fields of an entry with their types and what a missing one reads as.
FIELDS = (
    ("timestamp", "string", None), ("session_id", "string", None), ("pii_spans_detected", "long", None), ("pii_types", "array<string>", None),
    ("placeholders_generated", "long", None), ("privacy_score", "long", None), ("hash", "string", None), ("prev_hash", "string", GENESIS),
    ("hash_recipe", "string", V1), ("request_id", "string", ""), ("client_requested_model", "string", ""), ("selected_route", "string", ""),
    ("upstream_requested_model", "string", ""), ("upstream_reported_model", "string", ""), ("detector_fast_model", "string", ""), ("detector_deep_model", "string", ""),
    ("prompt_hmac", "string", ""), ("response_hmac", "string", ""), ("hmac_key_id", "string", ""), ("response_hash_status", "string", "pending"),
    ("signing_key_id", "string", ""), ("signature_alg", "string", ""), ("anchor_status", "string", "not_yet_anchored"), ("rekor_uuid", "string", ""),
    ("log_index", "long", -1), ("integrated_time", "long", 0),
)
DDL = ", ".join(f"{n} {t}" for n, t, _ in FIELDS)


def with_defaults(entries: DataFrame) -> DataFrame:
    """All fields, missing ones as their defaults; other columns stay."""
    have = set(entries.columns)
    for name, kind, default in FIELDS:
        if name not in have:
            entries = entries.withColumn(name, F.lit(default).cast(kind))
        elif default is not None:
            entries = entries.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return entries


def canonical_json(field=F.col, written: dict[str, str] | None = None) -> Column:
    """Compact JSON of all fields but hash, in alphabetical order. written: names that another writer's files use."""
    names = sorted(((written or {}).get(n, n), n) for n, *_ in FIELDS if n != "hash")
    return F.to_json(F.struct(*[field(n).alias(name) for name, n in names]), {"ignoreNullFields": "false"})


def text_v1(field=F.col) -> Column:
    """What the legacy recipe hashes before the previous hash; timestamps have +00:00 in place of Z."""
    stamp = F.regexp_replace(field("timestamp"), "Z$", "+00:00")
    return F.concat(stamp, field("session_id"), field("pii_spans_detected").cast("string"), field("privacy_score").cast("string"))


def hash_v1(field=F.col) -> Column:
    return F.sha2(F.concat(text_v1(field), field("prev_hash")), 256)


def entry_hash(field=F.col, written: dict[str, str] | None = None) -> Column:
    recipe = field("hash_recipe")
    return F.when(recipe == V1, hash_v1(field)).when(recipe == V2, F.sha2(canonical_json(field, written), 256)).otherwise(F.raise_error(F.concat(F.lit("unknown hash recipe "), recipe)).cast("string"))


def build_chains(entries: DataFrame, chain: str = "chain_id", position: str = "pos") -> DataFrame:
    """entries with prev_hash and hash, each chain from the genesis hash.

    A chain is sequential by definition: entry i needs hash i-1. Everything else of what is hashed is put together in
    parallel, as text before and after the previous hash; then each chain passes by in order, and only its last hash
    is held. Chains run in parallel; a writer that wants more keeps a chain for each session or day.
    """
    data = [n for n, *_ in FIELDS if n not in ("hash", "prev_hash", chain, position)]
    recipe, mark = F.col("hash_recipe"), '"prev_hash":"'
    # Quotes inside of values are escaped, so the mark stands in the JSON once.
    json = canonical_json(lambda n: F.lit("") if n == "prev_hash" else F.col(n))
    cut = F.instr(json, mark) + len(mark) - 1
    before = F.when(recipe == V1, text_v1()).when(recipe == V2, F.substring(json, F.lit(1), cut)).otherwise(F.raise_error(F.concat(F.lit("unknown hash recipe "), recipe)).cast("string"))
    after = F.when(recipe == V1, "").otherwise(F.substring(json, cut + 1, F.length(json)))
    rows = with_defaults(entries).select(chain, position, *data, before.alias("_before"), after.alias("_after"))
    kept = rows.drop("_before", "_after")
    names = kept.columns

    def run(batches):
        now, last = None, GENESIS
        for batch in batches:
            previous, hashes = [], []
            for name, x, y in zip(*(batch.column(c).to_pylist() for c in (chain, "_before", "_after")), strict=True):
                if name != now:
                    now, last = name, GENESIS
                previous.append(last)
                last = hashlib.sha256(f"{x}{last}{y}".encode()).hexdigest() if x is not None else None
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(previous, pa.string()), pa.array(hashes, pa.string())], names=[*names, "prev_hash", "hash"])

    out = kept.withColumn("prev_hash", F.lit("")).withColumn("hash", F.lit("")).schema
    return rows.repartition(chain).sortWithinPartitions(chain, position).mapInArrow(run, out)


def verified_entries(entries: DataFrame, chain: str = "chain_id", order: tuple[str, ...] = ("pos",), unknown_recipe_fails: bool = True) -> DataFrame:
    """Adds hash_ok and link_ok to every entry. Hashes are checked row by row; links need one ordering of each chain."""
    rows = with_defaults(entries)
    recipe = F.col("hash_recipe")
    computed = F.when(recipe == V1, hash_v1()).when(recipe == V2, F.sha2(canonical_json(), 256))
    if not unknown_recipe_fails:
        computed = entry_hash()
    before = F.lag("hash").over(Window.partitionBy(chain).orderBy(*order))
    return rows.withColumn("hash_ok", F.coalesce(computed == F.col("hash"), F.lit(False))).withColumn("link_ok", F.col("prev_hash") == F.coalesce(before, F.lit(GENESIS)))


def verify_chains(entries: DataFrame, chain: str = "chain_id", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """chain, entries, valid, first_bad (number of the first wrong entry, from 1). An absent chain is valid: no row."""
    checked = verified_entries(entries, chain, order).withColumn("_n", F.row_number().over(Window.partitionBy(chain).orderBy(*order)))
    good = F.col("hash_ok") & F.col("link_ok")
    return checked.groupBy(chain).agg(F.count("*").alias("entries"), F.bool_and(good).alias("valid"), F.min(F.when(~good, F.col("_n"))).alias("first_bad"))


def last_hash(entries: DataFrame, chain: str = "chain_id", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    return entries.groupBy(chain).agg(F.max_by("hash", F.struct(*order)).alias("head"))


def receipt(entries: DataFrame, request_id: str, day: str) -> DataFrame:
    """The receipt of a request written on a day or the day before; the filter prunes partitions by day."""
    return entries.filter(F.col("day").between(F.date_sub(F.lit(day).cast("date"), 1), F.lit(day).cast("date")) & (F.col("request_id") == request_id)).limit(1)


def receipts(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The receipts of many requests at once. wanted: request_id, day; one entry of each, of the day or the day before."""
    asked = wanted.select(F.col("request_id").alias("_request"), F.col("day").alias("_asked")).distinct()
    near = F.col("day").between(F.date_sub("_asked", 1), F.col("_asked"))
    found = entries.join(asked, (F.col("request_id") == F.col("_request")) & near)
    return found.dropDuplicates(["_request", "_asked"]).drop("_request", "_asked")


def verify_receipts(receipts: DataFrame, key_id: str | None = None) -> DataFrame:
    """Adds verdict: ok, hash_mismatch, unknown_recipe, or key_mismatch (the key's id, not the digests, is compared)."""
    rows = with_defaults(receipts)
    recipe = F.col("hash_recipe")
    computed = F.when(recipe == V1, hash_v1()).when(recipe == V2, F.sha2(canonical_json(), 256))
    verdict = F.when(computed.isNull(), "unknown_recipe").when(computed != F.col("hash"), "hash_mismatch")
    if key_id is not None:
        verdict = verdict.when(F.col("hmac_key_id") != key_id, "key_mismatch")
    return rows.withColumn("verdict", verdict.otherwise("ok"))


def merkle_levels(leaves: Column) -> Column:
    """The height of a tree over so many leaves: the binary digits of leaves - 1."""
    return F.length(F.bin(leaves - 1))


def merkle_root(leaves: Column) -> Column:
    """Hex root of an array of hex digests: SHA-256 of raw pairs, an odd last node goes up unchanged. Null if empty."""

    def up(nodes: Column) -> Column:
        n = F.size(nodes)
        pairs = F.transform(F.sequence(F.lit(0), F.floor((n + 1) / 2).cast("int") - 1), lambda i: F.when(2 * i + 1 < n, F.sha2(F.concat(F.unhex(F.get(nodes, 2 * i)), F.unhex(F.get(nodes, 2 * i + 1))), 256)).otherwise(F.get(nodes, 2 * i)))
        return F.when(n > 1, pairs).otherwise(nodes)

    levels = merkle_levels(F.greatest(F.size(leaves), F.lit(1)))
    folded = F.aggregate(F.sequence(F.lit(1), levels), leaves, lambda nodes, _: up(nodes))
    return F.when(F.size(leaves) > 0, folded[0])


def merkle_root_of(leaves: list[str]) -> str:
    """The same root for streams, whose state is Python's."""
    nodes = leaves
    while len(nodes) > 1:
        pairs = [hashlib.sha256(bytes.fromhex(a + b)).hexdigest() for a, b in zip(nodes[::2], nodes[1::2], strict=False)]
        nodes = pairs + nodes[len(pairs) * 2 :]
    return nodes[0]


#: Leaves of a subtree.
SUBTREE = 4096


def merkle_roots(heads: DataFrame, batch: str, order: str, head: str = "head") -> DataFrame:
    """batch, n_heads, first_head, last_head, merkle_root.

    A batch is numbered in order; subtrees of SUBTREE leaves, which begin at multiples of it, are folded apart, and then
    only their roots come together.
    """
    number = F.row_number().over(Window.partitionBy(batch).orderBy(order)).cast("long") - 1
    rows = heads.select(batch, number.alias("_p"), F.col(head).alias("_h"))
    in_order = lambda x: F.transform(F.array_sort(x), lambda y: y["_h"])
    parts = rows.groupBy(batch, F.floor(F.col("_p") / SUBTREE).alias("_s")).agg(
        F.collect_list(F.struct("_p", "_h")).alias("_x"), F.count("*").alias("_n"), F.min_by("_h", "_p").alias("_first"), F.max_by("_h", "_p").alias("_last"),
    )
    parts = parts.select(batch, "_n", "_first", "_last", F.struct(F.col("_s").alias("_p"), merkle_root(in_order(F.col("_x"))).alias("_h")).alias("_node"))
    whole = parts.groupBy(batch).agg(
        F.sum("_n").cast("int").alias("n_heads"), F.min_by("_first", F.col("_node._p")).alias("first_head"), F.max_by("_last", F.col("_node._p")).alias("last_head"), F.collect_list("_node").alias("_x"),
    )
    return whole.select(batch, "n_heads", "first_head", "last_head", merkle_root(in_order(F.col("_x"))).alias("merkle_root"))


def pending_heads(heads: DataFrame, chain: str, order: str, head: str = "head") -> DataFrame:
    """Heads to anchor: not empty, and not the same as the last non-empty one before."""
    rows = heads.filter(F.col(head) != "")
    return rows.withColumn("_b", F.lag(head).over(Window.partitionBy(chain).orderBy(order))).filter(F.col("_b").isNull() | (F.col("_b") != F.col(head))).drop("_b")


def anchor_batches(heads: DataFrame, chain: str, order: str, published: str) -> DataFrame:
    """Adds batch: attempts that fail leave their heads for the next, so a batch ends with a successful attempt.

    published: true on rows at which an attempt succeeds. Heads after the last success have a null batch.
    """
    by = Window.partitionBy(chain).orderBy(order)
    done = F.sum(F.col(published).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum(F.col(published).cast("int")).over(Window.partitionBy(chain))
    batch = F.coalesce(done, F.lit(0))
    return heads.withColumn("batch", F.when(batch < total, batch))


def publish_backoff(attempts: DataFrame, chain: str, order: str, ok: str, first: int = 30, most: int = 3600) -> DataFrame:
    """Adds wait_seconds after each attempt: first after a success, doubled with each failure in a row up to most."""
    by = Window.partitionBy(chain).orderBy(order)
    island = F.sum(F.col(ok).cast("int")).over(by)
    rows = attempts.withColumn("_i", island)
    failures = F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(chain, "_i").orderBy(order))
    return rows.withColumn("wait_seconds", F.least(F.lit(first) * F.pow(F.lit(2.0), F.least(failures, F.lit(20))), F.lit(most)).cast("int")).drop("_i")


def chain_head(entries: DataFrame, checkpoints: DataFrame, chain: str = "chain_id", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """chain, head, entries, anchored_head, log_index (-1 if nothing is anchored). Checkpoints: chain, last_head, log_index."""
    heads = entries.groupBy(chain).agg(F.max_by("hash", F.struct(*order)).alias("head"), F.count("*").alias("entries"))
    latest = checkpoints.groupBy(chain).agg(F.max_by("last_head", "log_index").alias("anchored_head"), F.max("log_index").alias("log_index"))
    return heads.join(latest, chain, "left").withColumn("log_index", F.coalesce("log_index", F.lit(-1).cast("long")))


def record_body(root: Column, signature: Column, pem: Column) -> Column:
    """JSON of a transparency-log record: base64 of signature and key, hex root."""
    return F.to_json(
        F.struct(
            F.lit("0.0.1").alias("apiVersion"), F.lit("hashedrekord").alias("kind"),
            F.struct(
                F.struct(F.struct(F.lit("sha256").alias("algorithm"), root.alias("value")).alias("hash")).alias("data"),
                F.struct(F.base64(signature.cast("binary")).alias("content"), F.struct(F.base64(pem.cast("binary")).alias("content")).alias("publicKey")).alias("signature"),
            ).alias("spec"),
        )
    )


def log_acceptance(answer: Column) -> Column:
    """(uuid, log_index, integrated_time) of a log's answer; null if it has no entry or no index."""
    entries = F.from_json(answer, "map<string,struct<logIndex:long,integratedTime:long,verification:struct<integratedTime:long>>>")
    uuid = F.array_min(F.map_keys(entries))
    value = F.try_element_at(entries, uuid)
    out = F.struct(uuid.alias("uuid"), value["logIndex"].alias("log_index"), F.coalesce(value["verification"]["integratedTime"], value["integratedTime"], F.lit(0).cast("long")).alias("integrated_time"))
    return F.when(value["logIndex"].isNotNull(), out)
