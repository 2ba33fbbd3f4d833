"""BPE encoding and decoding with a tokenization automaton compiled from the merge list.

The automaton reads tokens. It starts with one state that allows every base symbol. Each merge (u, v), in
priority order, is one gadget: the new token uv may be read wherever u may be read, and leads where v led;
the u arcs move to a copy of their old target that lacks the v arc. So a state is a version: its parent, the
token it lost, and the step at which it lost it. In the finished automaton exactly one path spells each word.

The finished automaton is compiled, once and on the driver, to flat tables that are broadcast: the tokens that each
state lost and when, the state that each token leads to, and a machine over byte symbols (next node, node to fall back
to, longest vocabulary entry that ends at a node, next shorter entry that ends with a token). Encoding a pre-split word
reads one symbol at a time: the machine's node gives the entries that end there, longest first, and the first whose
arc the table allows in the state before it is the arc of the one path. New words go through the tables together, one
position of all of them at a time; very long ones go alone. Decoding emits arc labels.

Texts come as numbers of words (see pieces), so each different word of a batch is read once. Ids and labels are joined
by Arrow, digests are taken a bounded part of a text at a time.

Nulls count as empty texts, which give no ids and an empty decoded text. Repeated rows and ids stay repeated.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from cloakline.llm import common, pieces

END = "</w>"
#: Bytes of the longest word that goes through the tables with others, and how many go together.
TOGETHER_BYTES, TOGETHER = 64, 1 << 14
#: Arcs that a very long word keeps besides the tables, and pieces that are joined at once.
ARCS_KEPT, PART = 100_000, 1 << 20
#: Letters below it are the same in all Unicode versions that matter.
SETTLED = "\u0500"
SPACE = pa.scalar(" ", pa.large_string())
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Table:
    """Values by 64-bit key; a map of bits, a few for each key, spares most searches for keys that it lacks."""

    def __init__(self, found: dict[int, int]):
        keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(found.values(), np.int32, len(found))[order]
        self.bits = max(len(found) * 6, 2).bit_length()
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._place(self.keys)] = True

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        maybe = np.flatnonzero(self.seen[self._place(keys)])
        if len(maybe):
            wanted = keys[maybe]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            out[maybe[hit]] = self.values[at[hit]]
        return out


class Automaton:
    """The compiled tables. States are versions (parent, lost token, step); state 0 lost nothing."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values(), default=-1) + 1
        self.symbols = byte_symbols()
        target, left, born = [0] * size, [-1] * size, [-1] * size
        versions = [(0, -1, -1)]
        for k, (a, b) in enumerate(merges):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if born[uv] >= 0:
                raise ValueError("two merges make the same token")
            left[uv], born[uv], target[uv] = u, k, target[v]
            versions.append((target[u], v, k))
            target[u] = len(versions) - 1
        self.size, self.left, self.born = size, np.array(left, np.int32), np.array(born, np.int32)
        number = {s: i for i, s in enumerate(dict.fromkeys([0, *target]))}
        self.target = np.array([number[s] for s in target], np.int32)
        self.losses = Table(dict(self._losses(number, versions)))
        self._machine(vocab)
        self._scalar: tuple | None = None

    def _losses(self, number: dict[int, int], versions: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
        """(state, token) as one key, and the step at which the state or one before it lost the token."""
        for state, row in number.items():
            at = state
            while at:
                at, token, step = versions[at]
                yield row * self.size + token, step

    def _machine(self, vocab: dict[str, int]) -> None:
        """Nodes are beginnings of vocabulary entries; a symbol that ends a word is another symbol than the same within."""
        length, shorter, own = [0] * self.size, [-1] * self.size, [-1]
        nodes: list[dict[int, int]] = [{}]
        for text, token in vocab.items():
            bare = text.removesuffix(END) if text != END else text
            if not all(c in self.symbols for c in bare):
                continue
            symbols = [self.symbols[c] for c in bare]
            symbols[-1] += 256 * (bare != text)
            node = 0
            for symbol in symbols:
                if symbol not in nodes[node]:
                    nodes[node][symbol] = len(nodes)
                    nodes.append({})
                    own.append(-1)
                node = nodes[node][symbol]
            own[node], length[token] = token, len(symbols)
        back, longest, queue = [0] * len(nodes), [-1] * len(nodes), deque([0])
        while queue:
            node = queue.popleft()
            for symbol, to in nodes[node].items():
                queue.append(to)
                at = back[node]
                while at and symbol not in nodes[at]:
                    at = back[at]
                back[to] = nodes[at].get(symbol, 0) if node else 0
                longest[to] = own[to] if own[to] >= 0 else longest[back[to]]
                if own[to] >= 0:
                    shorter[own[to]] = longest[back[to]]
        self.next = Table({node * 512 + symbol: to for node, moves in enumerate(nodes) for symbol, to in moves.items()})
        self.first = np.array([nodes[0].get(s, 0) for s in range(512)], np.int32)
        self.back, self.longest, self.length, self.shorter = (np.array(x, np.int32) for x in (back, longest, length, shorter))

    def allowed(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for its token. A made token got its arc where its left part had one at that step."""
        out = np.ones(len(tokens), bool)
        until, live, token = np.full(len(tokens), 1 << 30, np.int32), np.arange(len(tokens)), tokens
        while len(live):
            step = self.losses.get(states[live].astype(np.int64) * self.size + token)
            refused = (step >= 0) & (step <= until[live])
            out[live[refused]] = False
            until[live] = self.born[token]
            token = self.left[token]
            live, token = live[~refused & (token >= 0)], token[~refused & (token >= 0)]
        return out

    def paths(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of pre-split words, given as bytes."""
        out: list = [None] * len(words)
        short = sorted((i for i, w in enumerate(words) if 0 < len(w) <= TOGETHER_BYTES), key=lambda i: -len(words[i]))
        for i in (i for i, w in enumerate(words) if not 0 < len(w) <= TOGETHER_BYTES):
            out[i] = self.path(words[i])
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            for i, ids in zip(some, self._together([words[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _together(self, words: list[bytes]) -> list[list[int]]:
        """Words in falling order of length; each position is read for all words that reach it."""
        sizes = np.array([len(w) for w in words])
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        last = np.full((len(words), sizes[0] + 1), -1, np.int32)
        node = np.zeros(len(words), np.int32)
        for end in range(1, sizes[0] + 1):
            n = int(np.searchsorted(-sizes, -end, "right"))
            symbol = data[starts[:n] + (end - 1)].astype(np.int64) + 256 * (sizes[:n] == end)
            at, to, lost = node[:n].astype(np.int64), np.zeros(n, np.int32), np.arange(n)
            while len(lost):
                found = self.next.get(at[lost] * 512 + symbol[lost])
                there = (found >= 0) | (at[lost] == 0)
                to[lost[there]] = np.maximum(found[there], 0)
                lost = lost[~there]
                at[lost] = self.back[at[lost]]
            node[:n] = to
            token, live = self.longest[to], np.arange(n)
            while len(live):
                if (token < 0).any():
                    raise ValueError("no token for a symbol")
                before = last[live, end - self.length[token]]
                ok = before < 0
                ok[~ok] = self.allowed(self.target[before[~ok]], token[~ok])
                last[live[ok], end] = token[ok]
                live, token = live[~ok], self.shorter[token[~ok]]
        backwards, place, rows = [], sizes.copy(), np.arange(len(words))
        while len(rows):
            token = last[rows, place[rows]]
            backwards.append((rows, token))
            place[rows] -= self.length[token]
            rows = rows[place[rows] > 0]
        owner, token = (np.concatenate(x[::-1]) for x in zip(*backwards, strict=True))
        order = np.argsort(owner, kind="stable")
        bounds = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        token = token[order].tolist()
        return [token[a:b] for a, b in zip([0, *bounds], bounds, strict=False)]

    def path(self, word: bytes | str) -> list[int]:
        """Token ids of one pre-split word, which may be very long."""
        if isinstance(word, str):
            word = bytes(self.symbols[c] for c in word)
        if self._scalar is None:
            self._scalar = (dict(zip(self.next.keys.tolist(), self.next.values.tolist(), strict=True)), *(x.tolist() for x in (self.back, self.longest, self.length, self.shorter, self.target)))
        step, back, longest, length, shorter, target = self._scalar
        last, node, known = array("i", [-1]), 0, {}
        for end in range(1, len(word) + 1):
            symbol = word[end - 1] + 256 * (end == len(word))
            while (to := step.get(node * 512 + symbol)) is None and node:
                node = back[node]
            node = to or 0
            token = longest[node]
            while token >= 0 and (before := last[end - length[token]]) >= 0:
                pair = (target[before], token)
                if pair not in known:
                    if len(known) >= ARCS_KEPT:
                        known.clear()
                    known[pair] = bool(self.allowed(np.array(pair[:1]), np.array(pair[1:]))[0])
                if known[pair]:
                    break
                token = shorter[token]
            if token < 0:
                raise ValueError(f"no token for {word[end - 1]!r}")
            last.append(token)
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= length[last[end]]
        return out[::-1]


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol stands for: printable ones for themselves, the others, in order, from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out = {chr(b): b for b in printable}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}


class Codec(pieces.WordIds):
    """A tokenizer file's normaliser and splitter around the automaton."""

    def __init__(self, source: str, automaton: Automaton | None = None):
        spec = json.loads(source)
        model = spec["model"]
        self.automaton = automaton or compiled(source)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {i: t for t, i in (*model["vocab"].items(), *special.items())}
        self.special, self.labels = special, labels
        top = max(labels, default=-1) + 1
        self.label_of = pa.array([labels.get(i) for i in range(top)], pa.large_string())
        self.digits_of = pa.array([str(i) for i in range(top)], pa.large_string())
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        # Texts are split by the file's own rules; Unicode tables differ between libraries, so only ASCII is split here.
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        rules = Tokenizer.from_str(source)
        self.normalise, self.presplit = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        # Letters and the marks after them are words of their own here, whatever their case.
        super().__init__(all([w for w, _ in self.presplit(self.normalise(x))] == y for x, y in (("ABC", ["abc"]), ("xyz.,", ["xyz", ".,"]))))

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isascii() and w.isalpha()] if self.folds else []
        self._put(plain, [w.lower().encode() for w in plain])
        letters = [w for w in words if not w.isascii() and w.isalpha() and max(w) < SETTLED] if self.folds else []
        normal = self.normalise(" ".join(letters)).split(" ")
        if len(normal) == len(letters):
            kept = [(w, x) for w, x in zip(letters, normal, strict=True) if x.isalpha()]
            self._put([w for w, _ in kept], [x.encode() for _, x in kept])
        for w in words:
            if w not in self.young:
                self.young[w] = pieces.packed(self.encode_piece(w))

    def _put(self, words: list[str], spelled: list[bytes]) -> None:
        self.young.update((w, pieces.packed(ids)) for w, ids in zip(words, self.automaton.paths(spelled), strict=True))

    def encode_piece(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isalpha():
            return self.automaton.path(piece.lower())
        out: list[int] = []
        for part in self.cut.split(piece) if self.cut else [piece]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if part.isascii() and part.isprintable():
                    words = self.split.findall(part.lower())
                else:
                    words = [w for w, _ in self.presplit(self.normalise(part))]
                for word in words:
                    out += self.automaton.path(word)
        return out

    def encode(self, text: str | None) -> list[int]:
        offsets, codes, every, starts, sizes = self.of_batch(pa.array([text], pa.string()))
        return every[pieces.spread(codes, starts, sizes)].tolist()

    def decode(self, ids) -> str:
        """Arc labels joined by one space, as a tokenizer file without a decoder asks for."""
        return " ".join([self.labels[i] for i in ids if i in self.labels])

    def digests(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        """Of each text: how many ids, the digest of ids in decimal, the digest of the decoded text."""
        n, ids, decoded = zip(*map(self._digests, pieces.parts(texts)), strict=True)
        return np.concatenate(n), [x for part in ids for x in part], [x for part in decoded for x in part]

    def _digests(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
        offsets, codes, every, starts, sizes = self.of_batch(texts)
        ends = pa.array(np.r_[starts, len(every)].astype(np.int32))
        joined = [pc.binary_join(pa.ListArray.from_arrays(ends, table.take(pa.array(every))), SPACE) for table in (self.digits_of, self.label_of)]
        n = np.diff(np.r_[0, np.cumsum(sizes[codes])][offsets])
        # Pieces without ids leave nothing, and no space either.
        there = sizes[codes] > 0
        codes, bounds = codes[there], np.r_[0, np.cumsum(there)][offsets]
        hashes = [[hashlib.sha256(), hashlib.sha256()] for _ in range(len(texts))]
        for a in range(0, len(codes), PART):
            b = min(a + PART, len(codes))
            low, high = np.maximum(bounds[:-1], a), np.minimum(bounds[1:], b)
            rows = np.flatnonzero(low < high)
            cuts, some = pa.array((np.r_[low[rows], b] - a).astype(np.int32)), pa.array(codes[a:b])
            for k, strings in enumerate(joined):
                parts = pc.binary_join(pa.ListArray.from_arrays(cuts, strings.take(some)), SPACE)
                _, places, data = parts.buffers()
                places, data = np.frombuffer(places, np.int64)[: len(parts) + 1].tolist(), memoryview(data)
                for row, x, y, later in zip(rows.tolist(), places, places[1:], (low[rows] > bounds[rows]).tolist(), strict=False):
                    if later:
                        hashes[row][k].update(b" ")
                    hashes[row][k].update(data[x:y])
        return n, *([h[k].hexdigest() for h in hashes] for k in (0, 1))


def compiled(source: str) -> Automaton:
    model = json.loads(source)["model"]
    return Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])


def codec(shared: tuple[str, str, Automaton]) -> Codec:
    """One codec for each worker, of the broadcast tables."""
    key, source, automaton = shared
    return common.kept(("codec", key), lambda: Codec(source, automaton))


def broadcast(spark: SparkSession, tokenizer_file: str) -> Broadcast:
    """The tokenizer file and its compiled tables, whose size doesn't depend on the data."""
    with open(tokenizer_file, encoding="utf-8") as file:
        source = file.read()
    return common.bounded_batches(spark).sparkContext.broadcast((hashlib.sha256(source.encode()).hexdigest(), source, compiled(source)))


def encode_decode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row. One narrow pass, nothing is shuffled."""
    shared = broadcast(docs.sparkSession, tokenizer_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            n, ids, decoded = own.digests(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(common.tidy(run, keeps=True), SCHEMA)


def encode_ids(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id and the ids themselves, as an array."""
    shared = broadcast(docs.sparkSession, tokenizer_file)

    def run(batches):
        own = codec(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(common.tidy(run, keeps=True), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id and decoded text of encode_ids' rows; null ids give an empty text, unknown ids nothing."""
    shared = broadcast(encoded.sparkSession, tokenizer_file)

    def run(batches):
        own = codec(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py() or ()) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(common.tidy(run, keeps=True), "doc_id long, text string")


def word_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"), word_bpe_file())
