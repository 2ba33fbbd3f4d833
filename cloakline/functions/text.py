"""Positions of pattern matches, code blocks, word counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def find_all(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of all non-empty matches, in code points.

    Texts come from regexp_extract_all and gaps from split: match i starts after the gaps up to it and the matches
    before it. Texts that don't match cost one search.
    """
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("out"))

    def place(pair: Column) -> Column:
        def step(acc, found):
            begin = acc["at"] + F.length(found["gap"])
            stop = begin + F.length(found["hit"])
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), stop.alias("end"), found["hit"].alias("text")))).alias("out"))

        both = F.zip_with(pair["hit"], F.slice(pair["gap"], F.lit(1), F.size(pair["hit"])), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
        return F.aggregate(both, start, step, lambda acc: acc["out"])

    pairs = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.split(text, pattern, -1).alias("gap"))
    return F.when(F.rlike(text, F.lit(pattern)), let(pairs, place)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)"))


def find_literal(text: Column, word: Column) -> Column:
    """Array of (start, end, text) of the non-overlapping occurrences of a literal; an empty one has none."""
    quoted = F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.split(text, quoted, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("out"))

    def step(acc, gap):
        begin = acc["at"] + F.length(gap)
        stop = begin + F.length(word)
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), stop.alias("end"), word.alias("text")))).alias("out"))

    found = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda acc: acc["out"])
    return F.when((word != "") & F.contains(text, word), found).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)"))


def word_count(text: Column) -> Column:
    """Runs of characters other than Unicode white space."""
    return F.regexp_count(text, F.lit("(?U)[^\\s]+"))


def code_pieces(text: Column) -> Column:
    """Array of (start, text, block): the text outside and inside fenced blocks, in order.

    Fences pair from the left. A block is its fences and what lies between; a last fence without a partner stays text.
    """
    parts = F.split(text, FENCE, -1)

    def build(parts: Column) -> Column:
        n = F.size(parts)
        # An odd piece is inside a block if a fence closes it, which needs a piece after it.
        inside = lambda i: (i % 2 == 1) & (i < n - 1)
        open_end = lambda i: (i % 2 == 1) & (i == n - 1)
        each = F.transform(parts, lambda p, i: F.struct(F.when(inside(i), F.concat(F.lit(FENCE), p, F.lit(FENCE))).when(open_end(i), F.concat(F.lit(FENCE), p)).otherwise(p).alias("text"), inside(i).alias("block")))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,text:string,block:boolean>>)").alias("out"))

        def step(acc, x):
            return F.struct((acc["at"] + F.length(x["text"])).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), x["text"].alias("text"), x["block"].alias("block")))).alias("out"))

        return F.aggregate(each, start, step, lambda acc: acc["out"])

    return let(parts, build)


def strip_code(text: Column) -> Column:
    """(text, blocks): blocks replaced by numbered markers, and the blocks themselves."""

    def build(pieces: Column) -> Column:
        blocks = F.transform(F.filter(pieces, lambda p: p["block"]), lambda p: p["text"])
        before = lambda i: F.size(F.filter(F.slice(pieces, F.lit(1), i), lambda p: p["block"]))
        marked = F.transform(pieces, lambda p, i: F.when(p["block"], F.concat(F.lit("__CODEBLOCK_"), before(i).cast("string"), F.lit("_"))).otherwise(p["text"]))
        return F.struct(F.array_join(marked, "").alias("text"), blocks.alias("blocks"))

    return let(code_pieces(text), build)


def restore_code(text: Column, blocks: Column) -> Column:
    """Markers replaced by their blocks, in order."""
    numbered = F.transform(blocks, lambda b, i: F.struct(i.alias("i"), b.alias("b")))
    return F.aggregate(numbered, text, lambda acc, x: F.replace(acc, F.concat(F.lit("__CODEBLOCK_"), x["i"].cast("string"), F.lit("_")), x["b"]))


def byte_offset(text: Column, position: Column) -> Column:
    """UTF-8 byte offset of a code point position."""
    return F.octet_length(F.substring(text, F.lit(1), position))


def excerpt(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def short_hash(value: Column) -> Column:
    return F.when(F.length(value) > 16, F.concat(F.left(value, F.lit(8)), F.lit("..."), F.right(value, F.lit(8)))).otherwise(value)


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")
