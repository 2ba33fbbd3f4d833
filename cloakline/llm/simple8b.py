"""Token-id files in Simple-8b words.

A word has a 4-bit selector over 60 data bits: selector 0 to 14 packs that many ids of equal width, 15 is an
escape whose id follows in a word of its own, for ids of more than 60 bits. Words are built a block of ids at a
time; each block starts a word and its place is in the block table, so that blocks decode apart from each other.

A file row is one image: a header of five unsigned 64-bit integers (magic, documents, ids, words, block length),
then document ids, lengths and block places as 64-bit integers, then the words, all little-endian. Images lie in
ascending document order in a Parquet container that Spark's commit protocol writes, so a lost executor's
half-written file is never read, whatever store the folder is in.

Nulls count as empty texts (the end id alone). Repeated doc_ids stay, next to each other, ordered by a hash of the
text. A null doc_id comes first. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakline.llm import common, pieces

#: Ids in a word and bits of each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = 60 // COUNTS
ESCAPE = 15
MAGIC = 0x31423853
BLOCK = 128
#: Ids after which an image ends; one document is never cut.
IMAGE_IDS = 1 << 17
#: Texts that show whether the model alone gives a lower-case word's ids.
PROBES = ("a", "abcxyz", "hello", "tokenization", "qzxjkvbwpf", "mmmmmmmmmmmmmmmmmmm", "theandofingtionment")
FILE_SCHEMA = "shard int, image int, first long, n_ids long, payload binary"
OUT_SCHEMA = "shard int, doc_id long, first long, n_tokens long, ids_crc32 long"


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words and the place of each block's first word. All blocks advance together, a word at a time."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // block)
    ends = np.minimum(np.arange(1, blocks + 1) * block, n)
    # selector of the word that would start at each id: the widest count whose ids all fit and lie in the block
    chosen = np.full(n, ESCAPE, dtype=np.int64)
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)
    at = np.arange(n)
    for selector in range(len(COUNTS) - 1, -1, -1):
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        misfit = ids >> np.uint64(width) != 0
        if selector < len(COUNTS) - 1 and misfit.all():
            break
        following = np.minimum.accumulate(np.where(misfit, at, n)[::-1])[::-1]
        chosen[(following - at >= count) & (left >= count)] = selector
    steps = np.r_[COUNTS, 0, 1][chosen]
    starts = np.r_[0, ends[:-1]]
    cursor, live, found = starts.copy(), np.arange(blocks), []
    while len(live):
        found.append((live, cursor[live]))
        cursor[live] += steps[cursor[live]]
        live = live[cursor[live] < ends[live]]
    owner = np.concatenate([x[0] for x in found])
    heads = np.concatenate([x[1] for x in found])
    order = np.argsort(heads, kind="stable")
    heads, owner = heads[order], owner[order]
    picked = chosen[heads]
    size = np.where(picked == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for selector in np.unique(picked):
        rows = heads[picked == selector]
        if selector == ESCAPE:
            words[place[picked == selector]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[picked == selector] + 1] = ids[rows]
            continue
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        word = np.full(len(rows), selector, np.uint64) << np.uint64(60)
        for k in range(count):
            word |= ids[rows + k] << np.uint64(k * width)
        words[place[picked == selector]] = word
    return words, place[np.searchsorted(owner, np.arange(blocks))]


def unpack(words: np.ndarray, places: np.ndarray | None = None, block: int = BLOCK) -> np.ndarray:
    """Ids of whole blocks' words. Escaped words are found first, since their second half has no selector.

    With the block table, every block must hold block ids, the last one at most as many.
    """
    words = np.asarray(words, dtype=np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    escapes = np.flatnonzero(selectors == ESCAPE)
    last = -1
    for i in escapes:  # an escape's second half may look like an escape
        if i != last:
            raw[i + 1] = True
            last = i + 1
    counts = np.where(raw, 1, np.r_[COUNTS, 0, 0][selectors])
    place = np.cumsum(counts) - counts
    if places is not None and len(words) and (place[places] != np.arange(len(places)) * block).any():
        raise ValueError("words and block table don't agree")
    out = np.zeros(int(counts.sum()), np.uint64)
    out[place[raw]] = words[raw]
    for selector in range(len(COUNTS)):
        rows = np.flatnonzero((selectors == selector) & ~raw)
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            out[place[rows] + k] = (words[rows] >> np.uint64(k * width)) & mask
    return out


def unpack_block(words: np.ndarray, places: np.ndarray, block: int) -> np.ndarray:
    """Ids of one block alone."""
    end = places[block + 1] if block + 1 < len(places) else len(words)
    return unpack(words[places[block] : end])


def image(doc_ids: list[int], texts_ids: list[bytes]) -> bytes:
    lengths = np.array([len(x) // 4 for x in texts_ids], "<i8")
    ids = np.frombuffer(b"".join(texts_ids), "<u4")
    words, places = pack(ids)
    head = np.array([MAGIC, len(doc_ids), len(ids), len(words), BLOCK], "<u8")
    return b"".join(x.tobytes() for x in (head, np.array(doc_ids, "<i8"), lengths, places.astype("<i8"), words.astype("<u8")))


def read_image(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths, block places, words."""
    magic, docs, ids, words, block = np.frombuffer(payload, "<u8", 5).tolist()
    blocks = -(-ids // block)
    if magic != MAGIC or len(payload) != 8 * (5 + 2 * docs + blocks + words):
        raise ValueError("not a token file, or cut short")
    cuts = np.cumsum([5, docs, docs, blocks, words])
    body = np.frombuffer(payload, "<i8")
    return body[cuts[0] : cuts[1]], body[cuts[1] : cuts[2]], body[cuts[2] : cuts[3]], body[cuts[3] : cuts[4]].view("<u8")


def unpack_range(words: np.ndarray, places: np.ndarray, start: int, end: int, block: int = BLOCK) -> np.ndarray:
    """Ids start to end alone: only the blocks that hold them are decoded."""
    first, last = start // block, -(-end // block)
    stop = places[last] if last < len(places) else len(words)
    return unpack(words[places[first] : stop])[start - first * block : end - first * block] if end > start else np.zeros(0, np.uint64)


class Encoder(pieces.WordIds):
    """The tokenizers library for new words. Words of ASCII letters go to the library's model, which is all that such a
    tokenizer does with them once they are lower-cased (a check at the start confirms both). New words of other letters
    go through the library together, as one text, and their ids are cut at the tokens that end a word. All other pieces
    go through it one by one.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = json.loads(source)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(0, bool)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if suffix and all(ids(x.upper()) == ids(x) == [t.id for t in self.tokenizer.model.tokenize(x)] for x in PROBES):
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        super().__init__(len(self.ends) > 0)

    def _apart(self, words: list[str]) -> None:
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.young.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(some, found, strict=True))

    def _together(self, words: list[str]) -> None:
        for k in range(0, len(words), 2048):
            some = words[k : k + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):  # a letter whose lower case or normal form is several words
                self._apart(some)
                continue
            data, bounds = ids.tobytes(), (cuts * 4).tolist()
            self.young.update((w, data[a:b]) for w, a, b in zip(some, [0, *bounds], bounds, strict=False))

    def _plain(self, words: list[str]) -> None:
        tokenize, young = self.tokenizer.model.tokenize, self.young
        for w in words:
            young[w] = pieces.packed([t.id for t in tokenize(w)])

    def learn(self, words: list[str]) -> None:
        short = [w for w in words if w.isalpha() and len(w) <= pieces.CACHED_CHARS] if self.folds else []
        self._plain([w for w in short if w.isascii()])
        self._together([w for w in short if not w.isascii()])
        self._apart([w for w in words if w not in self.young])

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        out: list[bytes] = []
        for part in pieces.parts(texts):
            offsets, codes, every, starts, sizes = self.of_batch(part)
            for a in range(0, len(part), 128):
                cuts = offsets[a : a + 129]
                some = codes[cuts[0] : cuts[-1]]
                ids = every[pieces.spread(some, starts, sizes)]
                places = np.r_[0, np.cumsum(sizes[some])][cuts - cuts[0]].tolist()
                out += [ids[x:y].tobytes() for x, y in pairwise(places)]
        return out


def encoder(source: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return common.kept(("encoder", hashlib.sha256(source.encode()).hexdigest()), lambda: Encoder(source))


def write(docs: DataFrame, tokenizer_file: str, end_id: int | None, path: str) -> None:
    """Encode all texts and write their ids in ascending doc_id order under path.

    Texts are dealt out by doc_id ranges, the only shuffle; each range is encoded, packed and written in one pass.
    """
    spark = common.bounded_batches(docs.sparkSession)
    source = spark.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(source.value)
        shard, number, first, size, ids, found = -1, 0, 0, 0, [], []

        def flush():
            nonlocal number, first, size, ids, found
            payload = image(ids, found)
            row = [pa.array([v], t) for v, t in ((shard, pa.int32()), (number, pa.int32()), (first, pa.int64()), (size, pa.int64()), (payload, pa.binary()))]
            number, first, size, ids, found = number + 1, first + size, 0, [], []
            return pa.RecordBatch.from_arrays(row, names=["shard", "image", "first", "n_ids", "payload"])

        for batch in batches:
            shard = batch.column(0)[0].as_py() if batch.num_rows else shard
            for doc_id, data in zip(batch.column(1).to_pylist(), own.encode(batch.column(2)), strict=True):
                ids.append(doc_id)
                found.append(data + tail)
                size += len(found[-1]) // 4
                if size >= IMAGE_IDS:
                    yield flush()
        if ids:
            yield flush()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    lowest = -(1 << 63)
    # A doc_id of very many rows goes to as many ranges as its texts' hashes need; equal rows may lie in any order.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("doc_id"), "text").withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(n, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(common.tidy(run, keeps=True), FILE_SCHEMA).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, digest_only: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (or the ids) of each document, from the files alone.

    Starts need each shard's count of ids: one row for each written range, added up in range order.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("shard").alias("of"), before.alias("before"))

    def run(batches):
        for batch in batches:
            for shard, first, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc_ids, lengths, places, words = read_image(payload.as_buffer().to_pybytes())
                ids = unpack(words, places).astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                parts = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                if digest_only:
                    last = pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())
                else:
                    last = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
                columns = [pa.array(np.full(len(parts), shard, np.int32)), pa.array(np.ascontiguousarray(doc_ids)), pa.array(starts + first), pa.array(np.ascontiguousarray(lengths)), last]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "first", "n_tokens", "ids_crc32" if digest_only else "ids"])

    schema = OUT_SCHEMA if digest_only else OUT_SCHEMA.replace("ids_crc32 long", "ids array<long>")
    rows = files.select("shard", "first", "payload").mapInArrow(common.tidy(run), schema).join(offsets, F.col("shard") == F.col("of"))
    lowest = -(1 << 63)
    return rows.select(F.when(F.col("doc_id") != lowest, F.col("doc_id")).alias("doc_id"), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32" if digest_only else "ids")


def read_some(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """doc_id and ids of a few documents (a bounded list): images pass by, and only their blocks are decoded."""
    asked = np.array(sorted(set(wanted)), np.int64)

    def run(batches):
        for batch in batches:
            for payload in batch.column(0):
                doc_ids, lengths, places, words = read_image(payload.as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                hit = np.flatnonzero(np.isin(doc_ids, asked))
                rows = [unpack_range(words, places, int(ends[k] - lengths[k]), int(ends[k])).astype(np.int64) for k in hit]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(doc_ids[hit])), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return spark.read.schema(FILE_SCHEMA).parquet(path).select("payload").mapInArrow(common.tidy(run), "doc_id long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakline.llm.bpe import word_bpe_file

    path = common.fresh_path(spark, "token_files")
    write(common.table(spark, sf_dir, "documents"), word_bpe_file(), 2, path)
    return read(spark, path)
