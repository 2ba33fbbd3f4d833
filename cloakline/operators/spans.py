"""Span algebra: offset checks, relocation, clusters, placeholders, substitution, restoration, scores."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.functions import text as tx
from cloakline.functions import types as ty
from cloakline.operators.detect import overlaps

#: Fixed value: what a placeholder looks like.
TOKEN = r"\[(?:" + "|".join(ty.PREFIXES) + r")_[a-f0-9]{8}\]"
MAPPING = "array<struct<placeholder_text:string,original_text:string,type:string>>"


def offsets_valid(text: Column, span: Column) -> Column:
    """0 <= start <= end <= length, and the text between them is the span's."""
    fits = (span["start"] >= 0) & (span["start"] <= span["end"]) & (span["end"] <= F.length(text))
    return F.coalesce(fits & (F.substring(text, span["start"] + 1, span["end"] - span["start"]) == span["text"]), F.lit(False))


def relocate(text: Column, spans: Column) -> Column:
    """Spans with right offsets. A span that is wrong goes to the first occurrence of its text that overlaps no range
    claimed by a span before it in the list; without one it is dropped. Spans are taken in the order of the list."""

    def occurrences(word: Column) -> Column:
        """Starts of all occurrences, overlapping ones included."""
        last = F.length(text) - F.length(word)
        return F.when((word != "") & (last >= 0) & F.contains(text, word), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, F.length(word)) == word)).otherwise(F.expr("cast(array() as array<int>)"))

    def step(out: Column, s: Column) -> Column:
        def at(i: Column) -> Column:
            return ty.span(s["type"], i, i + F.length(s["text"]), s["text"], s["confidence"], s["implicit"])

        free = F.filter(occurrences(s["text"]), lambda i: ~F.exists(out, lambda o: (o["start"] < i + F.length(s["text"])) & (i < o["end"])))
        return F.when(offsets_valid(text, s), F.concat(out, F.array(s))).otherwise(tx.let(free, lambda f: F.when(F.size(f) > 0, F.concat(out, F.array(at(f[0])))).otherwise(out)))

    return F.when(F.forall(spans, lambda s: offsets_valid(text, s)), spans).otherwise(F.aggregate(spans, F.expr(ty.NO_SPANS), step))


def clusters(spans: Column) -> Column:
    """Partly overlapping spans joined: one span over their union, with the type of the longest (the first of equals).

    spans: sorted by start, offsets right. Disjoint spans stay as they are, so nothing changes for them.
    """

    def step(out: Column, s: Column) -> Column:
        n = F.size(out)
        last = out[n - 1]
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.when(s["end"] - s["start"] > last["longest"], s["type"]).otherwise(last["type"]).alias("type"), F.greatest(last["longest"], s["end"] - s["start"]).alias("longest"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), (s["end"] - s["start"]).alias("longest"))
        return F.when((n > 0) & (s["start"] < F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(0))), F.concat(F.slice(out, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(out, F.array(own)))

    return F.aggregate(spans, F.expr("cast(array() as array<struct<start:int,end:int,type:string,longest:int>>)"), step)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC of a string or binary column. The pads are computed here; the two digests in the JVM."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def placeholder_id(session: Column, message: Column, original: Column, key: bytes | None = None) -> Column:
    """Eight hex digits that follow from session, message and text, keyed if a key is given.

    Without a key anyone can try candidates for a short original; use a key outside of tests.
    """
    source = F.concat_ws(":", session, message.cast("string"), original)
    return F.left(hmac_sha256(key, source) if key else F.sha2(source, 256), F.lit(8))


def redact(text: Column, spans: Column, session: Column, message: Column, key: bytes | None = None) -> Column:
    """(text, mappings, n_spans): each cluster of spans replaced by a placeholder, one for each distinct original.

    A placeholder's type is that of the right-most occurrence of its text. spans must be sorted and right.
    """

    def named(found: Column) -> Column:
        pieces = F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["type"].alias("type"), F.substring(text, c["start"] + 1, c["end"] - c["start"]).alias("original")))

        def tokens(p: Column) -> Column:
            def token(c: Column) -> Column:
                same = F.filter(p, lambda o: o["original"] == c["original"])
                type_ = F.element_at(same, -1)["type"]
                return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["original"].alias("original"), type_.alias("type"), F.concat(F.lit("["), ty.prefix(type_), F.lit("_"), placeholder_id(session, message, c["original"], key), F.lit("]")).alias("token"))

            return F.transform(p, token)

        return tx.let(pieces, tokens)

    def rebuild(t: Column) -> Column:
        gaps = F.transform(t, lambda c, i: F.concat(F.substring(text, F.when(i == 0, 0).otherwise(F.get(t, i - 1)["end"]) + 1, c["start"] - F.when(i == 0, 0).otherwise(F.get(t, i - 1)["end"])), c["token"]))
        tail = F.substring(text, F.element_at(t, -1)["end"] + 1, F.length(text))
        maps = F.array_distinct(F.transform(t, lambda c: F.struct(c["token"].alias("placeholder_text"), c["original"].alias("original_text"), c["type"].alias("type"))))
        return F.struct(F.concat(F.array_join(gaps, ""), tail).alias("text"), maps.alias("mappings"))

    done = tx.let(named(clusters(spans)), rebuild)
    plain = F.struct(text.alias("text"), F.expr(f"cast(array() as {MAPPING})").alias("mappings"))
    return F.when(F.size(spans) > 0, done).otherwise(plain)


def restore(text: Column, mappings: Column) -> Column:
    """Known placeholders replaced by their originals in one pass; unknown ones and originals aren't looked at again.

    mappings: map from placeholder to original.
    """
    hits = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN, -1)

    def rebuild(x: Column) -> Column:
        done = F.transform(x["hits"], lambda h, i: F.concat(F.coalesce(F.try_element_at(mappings, h), h), F.get(x["gaps"], i + 1)))
        return F.concat(x["gaps"][0], F.array_join(done, ""))

    return F.when(F.rlike(text, F.lit(TOKEN)), tx.let(F.struct(hits.alias("hits"), gaps.alias("gaps")), rebuild)).otherwise(text)


def privacy_score(spans: Column) -> Column:
    """100 less the spans' weighted confidences, cut off towards zero. Summed in list order, so reruns agree."""
    total = F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + ty.weight(s["type"], s["implicit"]) * s["confidence"])
    return F.least(F.lit(100), F.floor(F.greatest(F.lit(0.0), 100.0 - total)).cast("int"))


def anonymize(df: DataFrame, spans: str = "spans", text: str = "text", session: str = "session_id", message: str = "message_idx", key: bytes | None = None, keep_code: bool = False) -> DataFrame:
    """Adds redacted, mappings, privacy_score, privacy_class. Wrong offsets are relocated first."""
    fixed = F.array_sort(F.transform(relocate(F.col(text), F.col(spans)), lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s.alias("span"))))
    out = df.withColumn("_fixed", F.transform(fixed, lambda x: x["span"]))
    out = out.withColumn("_done", redact(F.col(text), F.col("_fixed"), F.col(session), F.col(message), key))
    out = out.withColumn("redacted", F.col("_done.text")).withColumn("mappings", F.col("_done.mappings")).withColumn("privacy_score", privacy_score(F.col(spans)))
    return out.withColumn("privacy_class", ty.classify(F.col("privacy_score"))).drop("_fixed", "_done")


def detect_outside_code(text: Column, detector) -> Column:
    """detector's spans on the pieces outside fenced blocks, in offsets of the whole text."""
    pieces = F.filter(tx.code_pieces(text), lambda p: ~p["block"])
    shifted = F.flatten(F.transform(pieces, lambda p: F.transform(detector(p["text"]), lambda s: ty.span(s["type"], s["start"] + p["start"], s["end"] + p["start"], s["text"], s["confidence"], s["implicit"]))))
    return F.when(F.contains(text, F.lit(tx.FENCE)), shifted).otherwise(detector(text))


def contained_anti_join(spans: DataFrame, key: str = "id") -> DataFrame:
    """Merge in relational form, for texts with very many spans: rows key, place, type, start, end, ..."""
    rank = F.struct((F.col("start") - F.col("end")).alias("len"), F.col("place").alias("place"))
    rows = spans.withColumn("_rank", rank)
    other = rows.select(F.col(key).alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("_rank").alias("_other"))
    inside = (F.col(key) == F.col("_key")) & (F.col("_start") <= F.col("start")) & (F.col("end") <= F.col("_end")) & (F.col("_other") < F.col("_rank"))
    return rows.join(other, inside, "left_anti").drop("_rank")


def overlapping(a: Column, b: Column) -> Column:
    return overlaps(a, b)
