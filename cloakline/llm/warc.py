"""WARC archives: writing page records, and reading them back with segment reassembly.

A page is a response record whose HTTP body is chunked, or a revisit of an earlier record with an equal payload.
A block above the segment size goes out as continuation records, which a writer may place in any file. Reading
takes records by Content-Length, groups continuations by origin identifier, orders them by segment number, checks
that numbers are complete and the total length holds, and decodes the chunked framing.

Archives are plain .warc.gz files written by Spark's text writer (its line separator is the record end), so the
commit protocol keeps half-written files out and any store will do. Only records of several segments are shuffled.
Archives of other writers are read too: records that are neither response, revisit nor continuation are passed over,
and without this writer's own headers page_id, refers_to and a revisit's payload_bytes are null.

Null html and url count as empty. Repeated page_ids and rows each get a record. Of equal payloads the row of the
smallest page_id, then url, is the response, and all others revisit it; where several rows are equal in all three, one
of them is. Which row that is follows from the values alone, so it doesn't matter how rows lie in partitions. A null
page_id counts as larger than any other. Records that can't be put together raise an error: nothing is lost silently.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm import common

END = "\r\n\r\n"
#: Payload bytes from which an equal payload is a revisit.
REVISIT_BYTES = 100
#: Code points of a chunk in the HTTP body, and of a segment of a block.
CHUNK, SEGMENT = 2048, 8192
#: Bytes that are inflated at once, and records of one file.
INFLATED, FILE_RECORDS = 1 << 20, 2000
GREATEST = (1 << 63) - 1
#: The types of records that are read.
KINDS = ("response", "revisit", "continuation")
PART = "record_id string, page_id long, record_type string, refers_to long, payload_digest string, declared long, origin string, number int, total long, block binary"


def head(*lines: Column) -> Column:
    return F.concat(F.lit("WARC/1.1"), *[F.concat(F.lit("\r\n"), x) for x in lines], F.lit(END))


def cut(text: Column, size: int) -> Column:
    """Pieces of size code points, one at least."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int")), lambda k: F.substring(text, k * size + 1, F.lit(size)))


def chunked(text: Column) -> Column:
    """HTTP chunked framing of the text's UTF-8 bytes."""
    frames = F.transform(cut(text, CHUNK), lambda c: F.concat(F.hex(F.octet_length(c)), F.lit("\r\n"), c, F.lit("\r\n")))
    return F.concat(F.when(text != "", F.array_join(frames, "")).otherwise(F.lit("")), F.lit("0" + END))


def digested(pages: DataFrame) -> DataFrame:
    """page_id (GREATEST for null), url, html, digest and n bytes of the payload."""
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(GREATEST)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.withColumn("digest", F.sha2("html", 256)).withColumn("n", F.octet_length("html").cast("long"))


def first_records(rows: DataFrame) -> DataFrame:
    """_digest, to, to_url of the response of each payload with several rows; same: rows equal in all three."""
    each = rows.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest", "page_id", "url").agg(F.count("*").alias("same"))
    first = each.groupBy("digest").agg(F.min(F.struct("page_id", "url", "same")).alias("first"), F.sum("same").alias("copies")).filter("copies > 1")
    return first.select(F.col("digest").alias("_digest"), F.col("first.page_id").alias("to"), F.col("first.url").alias("to_url"), F.col("first.same").alias("same"))


def identifier(*parts: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("\n", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per WARC record: its text without the record end."""
    rows = digested(pages)
    firsts = common.staged(first_records(rows), "first_records")
    joined = rows.join(firsts, F.col("digest") == F.col("_digest"), "left")
    is_first = (F.col("page_id") == F.col("to")) & (F.col("url") == F.col("to_url"))
    kind = F.when(F.col("to").isNull() | is_first, "response").otherwise("revisit")
    # A first record's identifier follows from its values, so revisits can name it; others are told apart by their place.
    place = F.when(F.col("to").isNull() | ~is_first, F.monotonically_increasing_id().cast("string")).otherwise(F.lit("first"))
    several = F.coalesce(is_first & (F.col("same") > 1), F.lit(False))
    columns = ["page_id", "url", "html", "digest", "n", "to", "to_url", "kind", "place"]
    out = joined.filter(~several).withColumn("kind", kind).withColumn("place", place).select(columns)
    again = firsts.filter("same > 1")
    if not again.isEmpty():
        # Rows equal in page, url and payload: the payload goes out once, the others are revisits without it.
        once = joined.filter(several).dropDuplicates(["digest"])
        out = out.unionByName(once.withColumn("kind", F.lit("response")).withColumn("place", F.lit("first")).select(columns))
        sizes = rows.join(again.select("_digest"), F.col("digest") == F.col("_digest"), "left_semi").groupBy("digest").agg(F.max("n").alias("n"))
        spans = again.join(sizes, F.col("_digest") == F.col("digest")).withColumn("k", F.explode(F.expr(f"sequence(0L, (same - 2) div {FILE_RECORDS})"))).repartition("digest", "k")
        rest = spans.withColumn("place", F.explode(F.expr(f"sequence(k * {FILE_RECORDS} + 2, least((k + 1) * {FILE_RECORDS} + 1, same))")))
        rest = rest.select(F.col("to").alias("page_id"), F.col("to_url").alias("url"), F.lit("").alias("html"), "digest", "n", "to", "to_url", F.lit("revisit").alias("kind"), F.concat(F.lit("again "), F.col("place").cast("string")).alias("place"))
        out = out.unionByName(rest.select(columns))
    return laid_out(out, segment)


def laid_out(rows: DataFrame, segment: int) -> DataFrame:
    """Records of rows (page_id, url, html, digest, n, to, to_url, kind, place), cut into segments."""
    rows = rows.withColumn("id", identifier(F.col("page_id").cast("string"), F.col("digest"), F.col("url"), F.col("place")))
    body = F.when(
        F.col("kind") == "revisit",
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END)),
    ).otherwise(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END), chunked(F.col("html"))))
    rows = rows.withColumn("block", body).withColumn("total", F.octet_length("block"))
    # Header values are one line each.
    rows = rows.withColumn("uri", F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20"))
    parts = rows.select("*", F.posexplode(cut(F.col("block"), segment)).alias("k", "part")).withColumn("parts", F.floor((F.greatest(F.length("block"), F.lit(1)) - 1) / segment) + 1)
    number = F.col("k") + 1
    own = F.when(F.col("k") == 0, F.col("id")).otherwise(F.concat(F.expr("left(id, length(id) - 1)"), F.lit("-"), number.cast("string"), F.lit(">")))
    line = lambda name, value: F.concat(F.lit(name + ": "), value)
    maybe = lambda condition, name, value: F.when(condition, F.concat(F.lit("\r\n" + name + ": "), value)).otherwise(F.lit(""))
    opening = F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("k") == 0, F.col("kind")).otherwise("continuation")), F.lit("\r\n"), line("WARC-Record-ID", own))
    extra = F.concat(
        maybe(F.lit(True), "WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        maybe(F.lit(True), "WARC-Target-URI", F.col("uri")),
        maybe(F.col("k") == 0, "X-Page-ID", F.col("page_id").cast("string")),
        maybe(F.col("k") == 0, "WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        maybe(F.col("kind") == "revisit", "WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        maybe(F.col("kind") == "revisit", "WARC-Refers-To", identifier(F.col("to").cast("string"), F.col("digest"), F.col("to_url"), F.lit("first"))),
        maybe(F.col("kind") == "revisit", "X-Refers-To-Page", F.col("to").cast("string")),
        maybe(F.col("parts") > 1, "WARC-Segment-Number", number.cast("string")),
        maybe(F.col("k") > 0, "WARC-Segment-Origin-ID", F.col("id")),
        maybe((F.col("parts") > 1) & (number == F.col("parts")), "WARC-Segment-Total-Length", F.col("total").cast("string")),
        maybe(F.lit(True), "Content-Length", F.octet_length("part").cast("string")),
    )
    return parts.select(F.concat(opening, extra, F.lit(END), F.col("part")).alias("value"))


def write(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    records(pages, segment).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class Damaged(ValueError):
    """An archive that can't be read back whole."""


def inflate(data: bytes) -> Iterator[bytes]:
    """Content of gzip members, a piece of bounded size at a time."""
    view, at, held, member = memoryview(data), 0, b"", None
    while held or at < len(view):
        if not held:
            held, at = view[at : at + INFLATED], at + INFLATED
        member = member or zlib.decompressobj(31)
        yield member.decompress(held, INFLATED)
        held = member.unused_data if member.eof else member.unconsumed_tail
        member = None if member.eof else member
    if member:
        yield member.flush()
        if not member.eof:
            raise Damaged("gzip member cut short")


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record; blocks are taken by Content-Length. One record is held at a time."""
    held, source = bytearray(), iter(pieces)

    def more() -> bool:
        piece = next(source, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while held or more():
        if not held:
            continue
        seen = 0
        while (stop := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(len(held) - 3, 0)
            if not more():
                raise Damaged("record without header end")
        if not held.startswith(b"WARC/1."):
            raise Damaged("no record where one should begin")
        lines = held[:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = stop + 4
        end = start + int(headers["content-length"])
        while len(held) < end + 4 and more():
            pass
        if held[end : end + 4] != b"\r\n\r\n":
            raise Damaged("record doesn't end where it says")
        yield headers, bytes(held[start:end])
        del held[: end + 4]


def assemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of segments (number, total length on the last, bytes) in any order."""
    parts = sorted(parts, key=lambda x: x[0])
    total = parts[-1][1]
    block = b"".join(x[2] for x in parts)
    if [x[0] for x in parts] != list(range(1, len(parts) + 1)) or total is None or total != len(block):
        raise Damaged("segments are missing, repeated or of another total length")
    return block


def payload_of(block: bytes) -> tuple[bytes, dict[str, str]]:
    """Body and headers of an HTTP response, unchunked."""
    stop = block.find(b"\r\n\r\n")
    if stop < 0:
        raise Damaged("no HTTP header end")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:stop].decode("latin-1").split("\r\n")[1:])}
    body = block[stop + 4 :]
    if headers.get("transfer-encoding", "").lower() != "chunked":
        return body, headers
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise Damaged("chunk size missing")
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out), headers
        piece = body[line + 2 : line + 2 + size]
        if len(piece) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise Damaged("chunk cut short")
        out.append(piece)
        at = line + 4 + size


def segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = [x.split(" ")[0] for x in PART.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    number = lambda h, k: int(h[k]) if k in h else None

    def row(h: dict[str, str], block: bytes) -> tuple:
        declared = number(payload_of(block)[1], "content-length") if h["warc-type"] == "revisit" and block else None
        name, _, digest = h.get("warc-payload-digest", "").partition(":")
        refers_to = number(h, "x-refers-to-page")
        origin = h.get("warc-segment-origin-id", h["warc-record-id"])
        return (h["warc-record-id"], number(h, "x-page-id"), h["warc-type"], refers_to, digest if name == "sha256" else None, declared, origin, number(h, "warc-segment-number"), number(h, "warc-segment-total-length"), block)

    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parse(inflate(content.as_buffer().to_pybytes())):
                    if h["warc-type"] not in KINDS:
                        continue
                    rows.append(row(h, block))
                    size += len(block)
                    if len(rows) == 200 or size >= common.ARROW_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(common.tidy(run), PART)


OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of each page."""
    parts = segments(spark, path)
    out = OUT if with_payload else OUT.rpartition(", ")[0]

    def page(origin: dict, block: bytes) -> tuple:
        if origin["record_type"] == "revisit":
            return (origin["page_id"], origin["declared"], origin["payload_digest"], "revisit", origin["refers_to"], None)
        payload, _ = payload_of(block)
        digest = hashlib.sha256(payload).hexdigest()
        if origin["payload_digest"] not in (None, digest):
            raise Damaged(f"payload of page {origin['page_id']} has another digest")
        return (origin["page_id"], len(payload), digest, "response", None, payload)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 if with_payload else 5]
    names = [x.split(" ")[0] for x in out.split(", ")]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True))[: len(types)] or [()] * len(types), types, strict=True)], names=names)

    def single(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                yield batch_of([page(r, r["block"]) for r in batch.slice(k, 200).to_pylist()])

    def several(key, group):
        rows = group.to_pylist()
        origin = next((r for r in rows if r["record_id"] == r["origin"]), None)
        if origin is None:
            raise Damaged(f"segments of {key[0].as_py()} have no first record")
        return pa.Table.from_batches([batch_of([page(origin, assemble([(r["number"], r["total"], r["block"]) for r in rows]))])])

    whole = parts.filter("number is null").mapInArrow(single, out)
    rebuilt = parts.filter("number is not null").groupBy("origin").applyInArrow(several, out)
    return whole.unionByName(rebuilt).withColumn("page_id", F.when(F.col("page_id") != GREATEST, F.col("page_id"))).withColumn("refers_to", F.when(F.col("refers_to") != GREATEST, F.col("refers_to")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "archives")
    write(common.table(spark, sf_dir, "pages"), path)
    return read(spark, path, with_payload=False)


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, cast(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""
