"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are subwords: the ids of a public byte-level tokenizer, so every script and every text has symbols of its own
and nothing is folded. A word that repeats the word before it costs nothing but counts with its characters: repetition
reads well word by word, and no trusted text has that little to say a character.

Training counts pairs of symbols over all trusted texts into a table that grows with them, sharded by hash. Contexts
and followers, one row for each symbol of the tokenizer's vocabulary, are summed from it and broadcast.

Scoring joins counts by shard. Each block of documents gathers its pairs, each once, with the documents that hold it
and how often; these go to the pair's shard, which holds its counts and gives back what each document gains over the
lower order there. A document's sum over the shards completes its negative log probability; perplexity is a
character's. Counts are spread over salts as the number of documents grows, so a shard's work is split further. So a
very frequent pair is a row for each block, never one for each document.

A trusted document is scored as if it had been left out: its own counts are taken off the table's. Each language's
thresholds are a low and a high quantile of these held-out perplexities with a margin beyond; documents outside them
are rejected: too strange above, too repetitive below. Means are taken as if PRIOR more characters of the language's
usual probability were there, so that short texts aren't rejected by chance.

Trusted documents are those with quality 1 in the labels table. Without any, nothing is rejected. A null or empty
text has no symbols and isn't rejected. A language without trusted documents takes the threshold over all languages.
Repeated rows count as often as they occur. Documents labelled more than once count once, as trusted if any label is.
A null doc_id is never trusted. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import ne

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm import common, pieces, simple8b
from cloakline.llm.bpe import word_bpe_file

PRIOR = 60
#: Trusted quantile (1 less it, below) and the margins below and above, in nats a character.
QUANTILE, MARGINS = 0.995, (0.3, 0.5)
#: Shards of the table of counts. It is laid out once for SALT_DOCS documents, or once for a document in SALT_GRAMS of
#: its pairs if those are more: so copies of the table stay a small part of what documents send there.
SHARDS, SALT_DOCS, SALT_GRAMS = 32, 1 << 17, 16
#: Different pairs that a task counts before it hands them on.
HELD = 2_000_000
SCORED = "doc_id long, lang string, digest long, n_chars_scored long, nll double, nll_held_out double"


def distinct_words(text: str | None) -> tuple[str, int]:
    """The words, less those that repeat the word before, one space apart; the characters of all so spaced."""
    words = (text or "").split()
    if not words:
        return "", 0
    size = sum(map(len, words)) + len(words)
    new = list(map(ne, words[1:], words))
    if False in new:
        words = [words[0], *[w for w, differs in zip(words[1:], new, strict=True) if differs]]
    return " ".join(words), size


class Symbols:
    """Pairs of symbols of texts. The symbol after the tokenizer's own ones stands before the first."""

    def __init__(self, source: str):
        self.encoder = simple8b.encoder(source)
        self.start = max(self.encoder.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        self.size = self.start + 1

    def pairs(self, texts: pa.Array) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Part by part, of each text: its pairs as numbers, previous symbol times size plus symbol; its characters."""
        for part in pieces.parts(texts):
            words = [distinct_words(t) for t in part.to_pylist()]
            out = []
            for data in self.encoder.encode([w for w, _ in words]):
                ids = np.r_[self.start, np.frombuffer(data, "<u4")].astype(np.int64)
                out.append(ids[:-1] * self.size + ids[1:])
            yield out, np.array([n for _, n in words], np.int64)


def source_of(tokenizer_file: str | None) -> str:
    with open(tokenizer_file or word_bpe_file(), encoding="utf-8") as file:
        return file.read()


def summed(several: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in order, each once, and the sums of their counts."""
    keys, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*several, strict=True) if several else ((), ())))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(texts: DataFrame, source) -> DataFrame:
    """gram, n: counts of pairs over all rows; each task sums its own first."""

    def run(batches):
        symbols, (keys, counts), new, size = Symbols(source.value), summed([]), [], 0
        for batch in batches:
            for own, _ in symbols.pairs(batch.column(0)):
                new.append(np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True))
                size += len(new[-1][0])
                if size > HELD // 4:
                    (keys, counts), new, size = summed([(keys, counts), *new]), [], 0
                if len(keys) > HELD:
                    yield from rows(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield from rows(*summed([(keys, counts), *new]))

    def rows(keys, counts):
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), pa.array(counts[k : k + 100_000])], names=["gram", "n"])

    return texts.mapInArrow(common.tidy(run, keeps=True), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more."""
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)]


@dataclass
class Lower:
    """What is broadcast: the discounts, and for each symbol its total as a context, the log of what it leaves to the lower order, and the lower order's log probability."""

    size: int
    discount: np.ndarray
    total: np.ndarray
    log_rest: np.ndarray
    log_lower: np.ndarray

    def base(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of each pair if it had never been counted."""
        return self.log_rest[grams // self.size] + self.log_lower[grams % self.size]

    def gain(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What the pair's count adds to that."""
        own = np.maximum(counts - self.discount[np.minimum(counts, 3)], 0) / np.maximum(self.total[grams // self.size], 1)
        return np.log1p(own * np.exp(-self.base(grams)))


def lower_order(counts: DataFrame, size: int) -> Lower:
    """From counts of pairs; everything that comes to the driver has a row for each symbol at most."""
    of_counts = counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    d = [0.0, *discounts_of(*of_counts)]
    kept_back = F.element_at(F.array(*map(F.lit, d[1:])), F.least(F.col("n"), F.lit(3)).cast("int"))
    heads = counts.groupBy(F.floor(F.col("gram") / size).cast("long").alias("v")).agg(F.sum("n").cast("double").alias("total"), F.sum(kept_back).alias("rest")).orderBy("v").toArrow()
    tails = counts.groupBy((F.col("gram") % size).alias("w")).agg(F.count("*").alias("n")).toArrow()
    total, rest, seen = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
    total[heads["v"].to_numpy()], rest[heads["v"].to_numpy()] = heads["total"].to_numpy(), heads["rest"].to_numpy()
    seen[tails["w"].to_numpy()] = tails["n"].to_numpy()
    below = np.array([0.0, *discounts_of(*((seen == k).sum() for k in (1, 2, 3, 4)))])[np.minimum(seen, 3)]
    every = max(seen.sum(), 1)
    lower = np.maximum(seen - below, 0) / every + (below.sum() / every if seen.any() else 1.0) / size
    return Lower(size, np.array(d), total, np.log(np.where(total > 0, rest / np.maximum(total, 1), 1.0)), np.log(lower))


def shard_of(grams: np.ndarray) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(59)).astype(np.int32) % SHARDS


def packed(grams: np.ndarray, docs: np.ndarray, times: np.ndarray) -> bytes:
    """Pairs of a block, each once with its documents: rows in order of pair and document."""
    keys, first = np.unique(grams, return_index=True)
    sizes = np.diff(np.r_[first, len(grams)])
    parts = [np.array([len(keys), len(grams)], "<u8"), np.diff(keys, prepend=0).astype("<u8"), sizes.astype("<u2"), docs.astype("<u2"), times.astype("<u4")]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, and how many documents hold each; documents, and how often they do."""
    data = zstandard.ZstdDecompressor().decompress(data)
    n, m = np.frombuffer(data, "<u8", 2).tolist()
    keys = np.cumsum(np.frombuffer(data, "<u8", n, 16).astype(np.int64))
    at = 16 + 8 * n
    return keys, np.frombuffer(data, "<u2", n, at), np.frombuffer(data, "<u2", m, at + 2 * n), np.frombuffer(data, "<u4", m, at + 2 * (n + m))


DOCS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("digest", pa.int64()), ("n", pa.int64()), ("base", pa.float64())])
#: Rows that meet in a shard: counts (gram, n), pairs of a block, and a block's documents, which only pass through.
MEETING = "shard int, salt int, kind int, gram long, n long, block long, payload binary"
COUNTS, PAIRS, DOCUMENTS = 0, 1, 2
SUMS = "block long, shard int, payload binary"


def counted(own: list[np.ndarray], first: int, model: Lower) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some of a block's documents, numbered from first on: each one's pairs once, the document, how often; each one's base."""
    each = [np.unique(g, return_counts=True) for g in own]
    doc = np.repeat(np.arange(len(each)), [len(g) for g, _ in each])
    grams, times = (np.concatenate(x) for x in zip(*each, strict=True))
    base = -np.bincount(doc, weights=times * model.base(grams), minlength=len(each))
    return grams, (doc + first).astype("<u2"), times.astype("<u4"), base


def blocks(docs: DataFrame, source, lower, salts: int) -> DataFrame:
    """MEETING rows of documents. An Arrow batch is a block; its number follows from where its rows lie."""

    def run(batches):
        symbols, number = Symbols(source.value), TaskContext.get().partitionId() << 24
        for batch in batches:
            if not batch.num_rows:
                continue
            found, first = [], 0
            for own, chars in symbols.pairs(batch.column(2)):
                found.append((*counted(own, first, lower.value), chars))
                first += len(own)
            grams, doc, times, base, chars = map(np.concatenate, zip(*found, strict=True))
            found.clear()
            info = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(chars), pa.array(base)], schema=DOCS).serialize().to_pybytes()
            shard, parts, payloads = shard_of(grams).astype(np.uint8), [], []
            for s in range(SHARDS):
                at = np.flatnonzero(shard == s)
                if len(at):
                    at = at[np.argsort(grams[at], kind="stable")]  # a pair's documents stay in order
                    parts.append(s)
                    payloads.append(packed(grams[at], doc[at], times[at]))
            n = len(parts) + 1
            salt, rest = (number + (number >> 24)) % salts, (number + (number >> 24)) % SHARDS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*parts, rest], pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([PAIRS] * len(parts) + [DOCUMENTS], pa.int32()),
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array([*payloads, info], pa.binary()),
                ],
                names=[x.split(" ")[0] for x in MEETING.split(", ")],
            )
            number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.xxhash64("text").alias("digest")).mapInArrow(common.tidy(run, keeps=True), MEETING)


def gains(meeting: DataFrame, lower) -> DataFrame:
    """SUMS rows: of each block and shard, its documents' gains, as counted and with their own counts left out."""

    def scored(keys, n, payload):
        grams, sizes, docs, times = unpacked(payload)
        at = np.minimum(np.searchsorted(keys, grams), max(len(keys) - 1, 0))
        counts = np.where(keys[at] == grams, n[at], 0) if len(keys) else np.zeros(len(grams), np.int64)
        model, times = lower.value, times.astype(np.int64)
        plain = np.repeat(model.gain(grams, counts), sizes)
        held_out = model.gain(np.repeat(grams, sizes), np.maximum(np.repeat(counts, sizes) - times, 0))
        return np.stack([np.bincount(docs, weights=times * x) for x in (plain, held_out)]).astype("<f4").tobytes()

    def run(batches):
        now, keys, n, table = None, [], [], None
        for batch in batches:
            shard, salt, kind = (batch.column(k).to_numpy() for k in range(3))
            out = []
            cuts = np.flatnonzero(np.diff(shard) | np.diff(salt) | np.diff(kind)) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist(), strict=True):
                if a == b:
                    continue
                if now != (shard[a], salt[a]):
                    now, keys, n, table = (shard[a], salt[a]), [], [], None
                if kind[a] == COUNTS:
                    keys.append(batch.column(3).slice(a, b - a).to_numpy())
                    n.append(batch.column(4).slice(a, b - a).to_numpy())
                    continue
                if table is None:
                    table = tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, n))
                    keys, n = [], []
                for r in range(a, b):
                    block, payload = batch.column(5)[r].as_py(), batch.column(6)[r].as_py()
                    out.append((block, int(shard[r]), scored(*table, payload)) if kind[a] == PAIRS else (block, -1, payload))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "shard", "payload"])

    return meeting.mapInArrow(common.tidy(run), SUMS)


def scores(docs: DataFrame, counts: DataFrame, lower: Lower, source) -> DataFrame:
    """SCORED rows: negative log probabilities of every row, as counted and held out. counts: gram, n."""
    spark = common.bounded_batches(docs.sparkSession)
    shared, salts = spark.sparkContext.broadcast(lower), docs.count() // max(SALT_DOCS, counts.count() // SALT_GRAMS) + 1

    def shards(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(batch.column(0).to_numpy())), *batch.columns], names=["shard", "gram", "n"])

    laid_out = counts.select("gram", "n").mapInArrow(shards, "shard int, gram long, n long").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    laid_out = laid_out.select("shard", "salt", F.lit(COUNTS).alias("kind"), "gram", "n", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("payload"))
    meeting = blocks(docs, source, shared, salts).unionByName(laid_out).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "gram")

    def complete(key, group):
        docs_row = [p for s, p in zip(group.column("shard").to_pylist(), group.column("payload").to_pylist(), strict=True) if s < 0]
        info = pa.ipc.read_record_batch(pa.py_buffer(docs_row[0]), DOCS)
        total = np.zeros((2, info.num_rows))
        for _, payload in sorted((s, p) for s, p in zip(group.column("shard").to_pylist(), group.column("payload").to_pylist(), strict=True) if s >= 0):
            part = np.frombuffer(payload, "<f4").reshape(2, -1)
            total[:, : part.shape[1]] += part
        nll = np.maximum(info.column(4).to_numpy() - total, 0.0)
        return pa.table([*info.columns[:4], pa.array(nll[0]), pa.array(nll[1])], names=[x.split(" ")[0] for x in SCORED.split(", ")])

    return gains(meeting, shared).groupBy("block").applyInArrow(complete, SCORED)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("doc_id").cast("long").alias("_trusted")).agg(F.max("quality").alias("q")).filter("q = 1 and _trusted is not null").select("_trusted")


def trusted_texts(rows: DataFrame, good: DataFrame) -> DataFrame:
    """text of the trusted rows: a map of bits lets nearly only those go into the join, which decides."""
    bits = rows.sparkSession.sparkContext.broadcast(common.bitmap(good.withColumnRenamed("_trusted", "doc_id")))

    def run(batches):
        for batch in batches:
            yield batch.select(["doc_id", "text"]).filter(pa.array(common.marked(bits.value, batch.column(2).to_numpy())))

    maybe = rows.filter("doc_id is not null").select("doc_id", "text", common.bit_of("doc_id").alias("bit")).mapInArrow(run, "doc_id long, text string")
    # Asked for as a merge join at every size, however many labels there are.
    return maybe.join(good.hint("merge"), F.col("doc_id") == F.col("_trusted"), "left_semi").select("text")


def train(texts: DataFrame, tokenizer_file: str | None = None) -> tuple[DataFrame, Lower]:
    """The table of counts and the lower order."""
    source = source_of(tokenizer_file)
    shared = common.bounded_batches(texts.sparkSession).sparkContext.broadcast(source)
    counts = common.staged(gram_counts(texts, shared), "grams")
    return counts, lower_order(counts, Symbols(source).size)


def _classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margins: tuple[float, float] = MARGINS, tokenizer_file: str | None = None) -> DataFrame:
    spark = common.bounded_batches(docs.sparkSession)
    good = common.staged(trusted_ids(labels), "trusted")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    counts, lower = train(trusted_texts(rows, good), tokenizer_file)
    source = spark.sparkContext.broadcast(source_of(tokenizer_file))
    both = scores(rows, counts, lower, source).join(good.hint("merge"), F.col("doc_id") == F.col("_trusted"), "left")
    trusted = F.col("_trusted").isNotNull()
    scored = common.staged(both.select("doc_id", "lang", "digest", "n_chars_scored", F.when(trusted, F.col("nll_held_out")).otherwise(F.col("nll")).alias("nll"), trusted.alias("trusted")), "scores")
    mine = scored.filter("trusted and n_chars_scored > 0")
    usual = common.staged(mine.groupBy("lang").agg(F.sum("nll").alias("a"), F.sum("n_chars_scored").alias("b")), "usual")
    total = usual.agg(F.sum("a"), F.sum("b")).first()
    everywhere = (total[0] / total[1]) if total[1] else float(np.log(lower.size))
    usual = usual.select(F.col("lang").alias("_l"), (F.col("a") / F.col("b")).alias("mean"))
    smoothed = scored.join(usual, F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")
    rate = (F.col("nll") + PRIOR * F.coalesce("mean", F.lit(everywhere))) / (F.col("n_chars_scored") + PRIOR)
    smoothed = common.staged(smoothed.withColumn("rate", rate).drop("mean"), "rates")
    mine = smoothed.filter("trusted and n_chars_scored > 0")
    ends = F.percentile_approx("rate", F.array(F.lit(1 - quantile), F.lit(quantile)), 10_000)
    by = mine.groupBy("lang").agg(ends.alias("ends"))
    overall = mine.agg(ends).first()[0] or [float("-inf"), float("inf")]
    out = smoothed.join(by.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left")
    low, high = (F.coalesce(F.col("ends")[k], F.lit(float(overall[k]))) + beyond for k, beyond in ((0, -margins[0]), (1, margins[1])))
    outside = (F.col("rate") > high) | (F.col("rate") < low)
    return out.select("doc_id", "lang", "digest", "n_chars_scored", F.exp("rate").alias("perplexity"), F.exp(low).alias("lower"), F.exp(high).alias("upper"), ((F.col("n_chars_scored") > 0) & outside).alias("rejected"))


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, lang, n_chars_scored, perplexity, lower, upper, rejected of every row. how: quantile, margins, tokenizer_file."""
    return _classify(docs, labels, **how).drop("digest")


def keep(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows that aren't rejected, with all their columns. Rows equal in doc_id and text go if one of them is rejected."""
    own = common.prefix(docs)
    out = _classify(docs, labels, **how).filter("rejected").select(F.col("doc_id").alias(own + "id"), F.col("digest").alias(own + "digest")).distinct()
    return docs.join(out, docs["doc_id"].cast("long").eqNullSafe(F.col(own + "id")) & (F.xxhash64(docs["text"]) == F.col(own + "digest")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
