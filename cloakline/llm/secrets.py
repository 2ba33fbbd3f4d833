"""Secret scans: fixed patterns and a linear-chain conditional random field.

The patterns give the base spans, which always stay. The field tags every token of a text (runs of letters, digits and
_+/-, other marks one by one) as outside a secret, its begin or its inside, from the token's shape, the words around it
and features of the whole file, and adds the spans that Viterbi decoding finds and that no base span touches. No token
is left out by its length or look. What depends on a word alone is scored once for each word of a worker. Where a
token's scores are such that no path through a secret can be the best one, whatever its neighbours' labels, the chain
falls apart; decoding the stretches between such tokens alone is exact.

The field is trained here, on a sample of documents of at most SAMPLE rows and SAMPLE_CHARS code points each
(documented bounds of the training set alone; scanning covers every text), in which the values of base spans are
secrets and all other tokens aren't, and on made-up lines of configuration, code and prose around random values.
Weights have a fixed size, whatever the input's.

Nulls count as empty texts, which have no spans. Offsets are code points. Repeated rows are scanned each. Extra
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm import common

#: The base patterns. Runs of access and hex are maximal, so the length may stand in the pattern.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
WEIGHTS = 1 << 16
SAMPLE, SAMPLE_CHARS = 300, 50_000
MADE_UP = 900
SEED = 11
#: Tokens of one training chain, and chains of one step.
CHAIN, STEP = 64, 32
#: Code points that are looked at together, and words above which their scores are reckoned anew.
BLOCK, KEPT = 1 << 18, 1 << 18
#: Tokens before one that its features ask for.
BACK = 4
HINTS = re.compile("pass|secret|token|key|auth|bearer|credential|pwd")
NOT_CORE = re.compile(r"[^A-Za-z0-9_+/-]")
WORD = re.compile(r"[A-Za-z0-9_+/-]+|[^\sA-Za-z0-9_+/-]")
CLASSES = str.maketrans(string.ascii_uppercase + string.ascii_lowercase + string.digits, "A" * 26 + "a" * 26 + "0" * 10)
REPEATS = re.compile(r"(.)\1\1+", re.S)
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def rendered(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def values(text: str) -> list[tuple[int, int]]:
    """Ranges of the secrets in base spans, for training: of assignments the value alone."""
    assigned = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return sorted(assigned + [(a, b) for a, k, b in base_spans(text) if k])


def classes(token: str) -> str:
    """The class of each character; marks are their own."""
    if token.isascii():
        return token.translate(CLASSES)
    return "".join("A" if c.isupper() else "a" if c.islower() or c.isalpha() else "0" if c.isdigit() else c for c in token)


def entropy(token: str) -> float:
    n, different = max(len(token), 1), set(token)
    return math.log2(n) - (sum(c * math.log2(c) for c in map(token.count, different)) / n if len(different) < len(token) else 0)


def file_features(text: str) -> list[str]:
    """Features of the whole text: how much of it is marks of code, digits, and its size."""
    n = max(len(text), 1)
    marks = sum(text.count(c) for c in "={}();_\"")
    return [f"fm{min(int(60 * marks / n), 6)}", f"fl{min(int(math.log10(n)), 5)}"]


def number(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % WEIGHTS


@functools.lru_cache(1 << 16)
def form_features(shape: str, size: int, bits: int, share: int, upper: bool, lower: bool, letters: bool) -> list[int]:
    names = ["bias", "s" + shape, f"n{size}", f"e{bits}", f"d{share}", f"m{upper:d}{lower:d}"]
    names += [x for h in (0, 1) for x in (f"h{h}", f"hm{h}{upper and lower:d}{letters:d}")] + [f"q{q}{letters:d}" for q in (0, 1)]
    return [number(x) for x in names]


prefix_feature = functools.lru_cache(1 << 16)(number)


#: Where word_features() puts what.
ALONE, HINTED, QUOTED, NEAR = slice(0, 7), (slice(7, 9), slice(9, 11)), (11, 12), slice(13, 17)


def word_features(token: str) -> list[int]:
    """Numbers of a word's features: alone, without and with a hint before it, without and with a mark before it that
    opens a value, and as the first, second and third word before another, and the next after it."""
    kinds, low = classes(token), token.lower()
    letters, n = kinds.count("A") + kinds.count("a"), max(len(token), 1)
    form = form_features(REPEATS.sub(r"\1\1", kinds)[:12], min(len(token) // 4, 12), int(2 * entropy(token)), 6 * letters // n, "A" in kinds, "a" in kinds, letters > 0)
    data = low.encode("utf-8", "replace")
    prefix = prefix_feature("p" + ("0" if kinds[:1] == "0" else low[:3]))
    return [*form[:6], prefix, *form[6:], *[zlib.crc32(data, place) % WEIGHTS for place in (1, 2, 3, 4)]]


class Words(dict):
    """Numbers of words in order of their first use, and what a field's scores need of each of them."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.new = field, []
        self.features = np.zeros((0, 17), np.int32)
        self.hint, self.quote = np.zeros(0, np.int8), np.zeros(0, np.int8)
        self.scores = np.zeros((0, 8, 2))  # by hint, by quote, and as neighbours

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        self.new.append(word)
        return len(self) - 1

    def ids(self, words: list[str]) -> np.ndarray:
        out = np.array([self[w] for w in words], np.int64)
        if self.new:
            old, n = len(self) - len(self.new), len(self)
            if n > len(self.hint):
                for name in ("features", "hint", "quote", "scores"):
                    a = getattr(self, name)
                    setattr(self, name, np.concatenate([a, np.zeros((n + n // 2 - len(a), *a.shape[1:]), a.dtype)]))
            rows = np.array([word_features(w) for w in self.new])
            w = self.field.w[rows]
            w = w[..., 1:] - w[..., :1]
            alone = w[:, ALONE].sum(axis=1)
            self.features[old:n] = rows
            self.hint[old:n] = [HINTS.search(x.lower()) is not None for x in self.new]
            self.quote[old:n] = [x in ("=", ":", '"') for x in self.new]
            self.scores[old:n] = np.concatenate([*[(alone + w[:, s].sum(axis=1))[:, None] for s in HINTED], w[:, QUOTED], w[:, NEAR]], axis=1)
            self.new = []
        return out

    def around(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Of words between BACK before and one after: numbers of each, of the three before and the next, whether one of
        the BACK before hints at a secret, and whether the last opens a value."""
        ids = self.ids(words)
        n = len(ids) - BACK - 1
        hint = np.max([self.hint[ids[i : i + n]] for i in range(BACK)], axis=0) if n else np.zeros(0, np.int8)
        this, one, two, three, after = (ids[i : i + n] for i in (BACK, BACK - 1, BACK - 2, BACK - 3, BACK + 1))
        return this, one, two, three, after, hint, self.quote[one]

    def advantage(self, words: list[str], of_file: np.ndarray) -> np.ndarray:
        """How far a token's scores as begin and as inside are above that as outside."""
        this, one, two, three, after, hint, quote = self.around(words)
        w = self.field.w[of_file]
        w = (w[..., 1:] - w[..., :1]).sum(axis=1)
        s = self.scores
        return s[this, hint] + s[this, 2 + quote] + s[one, 4] + s[two, 5] + s[three, 6] + s[after, 7] + w[hint]

    def rows(self, words: list[str], of_file: np.ndarray) -> np.ndarray:
        """Numbers of each token's active features."""
        this, one, two, three, after, hint, quote = self.around(words)
        f, hinted = self.features, np.array([range(s.start, s.stop) for s in HINTED])
        parts = [f[this, ALONE], f[this[:, None], hinted[hint]], f[this, np.array(QUOTED)[quote]][:, None]]
        near = [f[x, NEAR.start + i][:, None] for i, x in enumerate((one, two, three, after))]
        return np.concatenate([*parts, *near, of_file[hint]], axis=1)


def file_numbers(text: str) -> np.ndarray:
    """Numbers of the file's features, for tokens without and with a hint before them."""
    names = file_features(text)
    return np.array([[number(x) for x in names + [f + f"h{h}" for f in names]] for h in (0, 1)])


class Field:
    """Weights of features by label, and of steps between labels; a chain starts and ends outside."""

    def __init__(self):
        self.w = np.zeros((WEIGHTS, 3))
        self.steps = np.zeros((3, 3))
        self.steps[OUTSIDE, INSIDE] = -1e6
        self.known: Words | None = None

    def __getstate__(self) -> dict:
        return {"w": self.w, "steps": self.steps, "known": None}

    def words(self) -> Words:
        if self.known is None or len(self.known) > KEPT:
            self.known = Words(self)
        return self.known

    def scores(self, rows: list[np.ndarray] | np.ndarray) -> np.ndarray:
        return self.w[np.asarray(rows)].sum(axis=-2)

    def viterbi(self, rows: list[np.ndarray]) -> list[int]:
        return self.best_path(self.scores(rows))

    def best_path(self, emit: np.ndarray) -> list[int]:
        """Labels of the best path through tokens between two outside ones."""
        best, back = self.steps[OUTSIDE] + emit[0], []
        for e in emit[1:]:
            total = best[:, None] + self.steps
            back.append(total.argmax(axis=0).astype(np.int8))
            best = total.max(axis=0) + e
        path = [int((best + self.steps[:, OUTSIDE]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """What a token's advantage as begin and as inside must stay below for outside to be better, whatever is around:
        where the next token isn't inside, and where it is and becomes a begin (its own change added)."""
        s, every = self.steps, (OUTSIDE, BEGIN, INSIDE)
        alone, joined = np.zeros(2), np.zeros(2)
        for label in (BEGIN, INSIDE):
            before = [a for a in every if (a, label) != (OUTSIDE, INSIDE)]
            alone[label - 1] = min(s[a, OUTSIDE] + s[OUTSIDE, b] - s[a, label] - s[label, b] for a in before for b in (OUTSIDE, BEGIN))
            joined[label - 1] = min(s[a, OUTSIDE] + s[OUTSIDE, BEGIN] + s[BEGIN, c] - s[a, label] - s[label, INSIDE] - s[INSIDE, c] for a in before for c in every)
        return alone, joined

    def open(self, above: np.ndarray, last: bool) -> np.ndarray:
        """Whether each token may be in a secret on a best path; all others are surely outside. last: the text ends here."""
        alone, joined = self.bounds()
        out = (above >= alone - 1e-6).any(axis=1)
        out[:-1] |= (above[:-1] + (above[1:, 1:] - above[1:, :1]) >= joined - 1e-6).any(axis=1)
        if len(out) and not last:
            out[-1] = True  # what follows isn't known here
        return out

    def log_partition(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition, forward and backward log sums, of one chain or of chains side by side in the second axis."""
        n = len(emit)
        ahead, behind = np.zeros(emit.shape), np.zeros(emit.shape)
        ahead[0] = self.steps[OUTSIDE] + emit[0]
        for t in range(1, n):
            ahead[t] = np.logaddexp.reduce(ahead[t - 1][..., None] + self.steps, axis=-2) + emit[t]
        behind[-1] = self.steps[:, OUTSIDE]
        for t in range(n - 2, -1, -1):
            behind[t] = np.logaddexp.reduce(self.steps + (emit[t + 1] + behind[t + 1])[..., None, :], axis=-1)
        return np.logaddexp.reduce(ahead[-1] + self.steps[:, OUTSIDE], axis=-1), ahead, behind

    def gradient(self, rows: list[np.ndarray] | np.ndarray, labels: list[int] | np.ndarray, real: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood, by token and label, and by step. Tokens that aren't real fill up shorter chains."""
        emit, labels = self.scores(rows), np.asarray(labels)
        if real is not None:
            emit[~real] = (0, -1e9, -1e9)
        z, ahead, behind = self.log_partition(emit)
        tokens = -np.exp(ahead + behind - z[..., None])
        tokens += np.eye(3)[labels]
        edge = np.full((1, *labels.shape[1:]), OUTSIDE)
        path = np.concatenate([edge, labels, edge])
        steps = np.bincount((3 * path[:-1] + path[1:]).ravel(), minlength=9).reshape(3, 3).astype(float)
        steps[OUTSIDE] -= np.exp(self.steps[OUTSIDE] + emit[0] + behind[0] - z[..., None]).reshape(-1, 3).sum(axis=0)
        steps[:, OUTSIDE] -= np.exp(ahead[-1] + self.steps[:, OUTSIDE] - z[..., None]).reshape(-1, 3).sum(axis=0)
        steps -= np.exp(ahead[:-1, ..., :, None] + self.steps + (emit[1:] + behind[1:])[..., None, :] - z[..., None, None]).reshape(-1, 3, 3).sum(axis=0)
        return tokens, steps

    def fit(self, rows: np.ndarray, labels: np.ndarray, real: np.ndarray, rounds: int = 6, rate: float = 0.3, decay: float = 1e-4) -> None:
        """AdaGrad over chains of CHAIN tokens, STEP at a time, in an order that a fixed seed gives."""
        squares, step_squares, rng = np.full_like(self.w, 1e-3), np.full((3, 3), 1e-3), np.random.default_rng(SEED)
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), STEP):
                some = order[at : at + STEP]
                r, is_real = rows[some].swapaxes(0, 1), real[some].T
                tokens, steps = self.gradient(r, labels[some].T, is_real)
                r, tokens = r[is_real], tokens[is_real]
                seen, where, times = np.unique(r, return_inverse=True, return_counts=True)
                where = where.ravel()
                g = np.stack([np.bincount(where, np.repeat(tokens[:, k], r.shape[1]), len(seen)) for k in range(3)], axis=1)
                g -= decay * times[:, None] * self.w[seen]
                squares[seen] += g * g
                self.w[seen] += rate * g / np.sqrt(squares[seen])
                step_squares += steps * steps
                self.steps += rate * steps / np.sqrt(step_squares)
                self.steps[OUTSIDE, INSIDE] = -1e6
        self.known = None


def made_up(n: int = MADE_UP, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made-up texts with the ranges of their secrets."""
    rng = random.Random(seed)
    pick = lambda alphabet, a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    mixed = letters + "0123456789"
    prose = lambda k: " ".join(pick("etaoinshrdlu", 2, 9) for _ in range(k))
    secret = [
        lambda: pick(mixed, 18, 44) + rng.choice("0123456789"), lambda: pick("0123456789abcdef", 32, 64), lambda: rng.choice(["ghp_", "sk-", "pk_", "xoxb-", "glpat-"]) + pick(mixed, 18, 40) + "7",
        lambda: pick(mixed + "+/", 30, 60) + "1", lambda: pick(mixed, 10, 14) + "9" + rng.choice("_-") + pick(mixed, 8, 12),
        lambda: rng.choice(["", "xoxb-", "sk-", "ghp_"]) + pick(letters, 18, 40) + "aB", lambda: "".join(pick("etaoinshrdlu", 4, 9).title() for _ in range(rng.randint(3, 5))),
    ]
    plain = [
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
        lambda: pick("0123456789", 8, 16), lambda: prose(1) + str(rng.randint(1, 999)), lambda: f"v{rng.randint(1, 9)}-{rng.randint(10, 99)}-release{rng.randint(1, 9)}", lambda: f"section-{rng.randint(1, 9)}/page-{rng.randint(1, 99)}",
        lambda: f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", lambda: pick("etaoinshrdlu", 3, 7) + "".join(pick("etaoinshrdlu", 3, 8).title() for _ in range(rng.randint(1, 3))),
        lambda: "Mc" + pick("etaoinshrdlu", 5, 9).title(),
    ]
    wordy = [lambda: pick("etaoinshrdlu", 4, 16), lambda: pick("abcdefghijklmnopqrstuvwxyz", 5, 20), lambda: pick(mixed, 4, 7), lambda: pick("0123456789", 4, 7)]
    assigns = ["pwd=", "PWD: ", "credentials = \"", "passphrase: ", "db_pass = '", "auth_key=", "\"pwd\": \""]
    lead = ["Authorization: Bearer ", "export AUTH_TOKEN=", "client_secret: ", "private key ", "credentials = \"", "pwd=", "aws_secret_access_key = ", "x-api-key: ", "conn.login('admin', '", "my access token is "]
    quiet = ["call ", "on ", "order ", "see ", "id ", "invoice no. ", "build ", "since ", "name = \"", "user: ", "mode=", "open('log', '"]
    talk = ["the password ", "a secret ", "this token ", "the access token is ", "your key ", "by key: ", "credentials are "]
    out = []
    for _ in range(n):
        text, spans = prose(rng.randint(0, 30)) + rng.choice([" ", "\n"]), []
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.15:
                text += rng.choice(assigns)
                spans.append((len(text), len(text := text + rng.choice(wordy)())))
            elif kind < 0.25:
                text += rng.choice(talk) + rng.choice(["valid", "must be changed", "expired", "is kept", prose(2)])
            elif kind < 0.6:
                text += rng.choice(lead)
                for part in range(2 if rng.random() < 0.1 else 1):
                    value = rng.choice(secret)()
                    start = spans.pop()[0] if part else len(text)
                    text += " " * part + value
                    spans.append((start, len(text)))
            else:
                text += rng.choice(quiet) + rng.choice(plain)()
            text += rng.choice(['"\n', "\n", " ", ". "]) + prose(rng.randint(0, 20)) + rng.choice([" ", "\n"])
        out.append((text, spans))
    return out


def examples_of(text: str, spans: list[tuple[int, int]], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all tokens: those under a span are its begin or inside."""
    found = list(WORD.finditer(text))
    labels, at, before = [], 0, None
    for m in found:
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        over = spans[at] if at < len(spans) and spans[at][0] < m.end() else None
        labels.append(OUTSIDE if over is None else INSIDE if over == before else BEGIN)
        before = over
    return words.rows([""] * BACK + [m[0] for m in found] + [""], file_numbers(text)), np.array(labels, np.int64)


def train(texts: list[str]) -> Field:
    field, rows, labels, real = Field(), [], [], []
    for text, spans in [(text, values(text)) for text in texts] + made_up():
        r, y = examples_of(text, spans, field.words())
        for at in range(0, len(r), CHAIN):
            part, fill = y[at : at + CHAIN].copy(), ((0, max(at + CHAIN - len(r), 0)), (0, 0))
            if part[0] == INSIDE:  # a chain starts outside
                part[0] = BEGIN
            rows.append(np.pad(r[at : at + CHAIN].astype(np.int32), fill))
            labels.append(np.pad(part, fill[0]))
            real.append(np.arange(CHAIN) < len(part))
    field.fit(np.array(rows), np.array(labels), np.array(real))
    return field


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of some BLOCK code points that cut no token."""
    at = 0
    while at < len(text):
        m = NOT_CORE.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = m.start() if m else len(text)
        yield at, end
        at = end


def open_tokens(text: str, field: Field) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(number, start, end, advantage) of the tokens that may be in a secret, in order."""
    before, n, of_file = [""] * BACK, 0, file_numbers(text)
    for start, end in blocks(text):
        tokens = WORD.findall(text, start, end)
        if not tokens:
            continue
        following = WORD.search(text, end)
        above = field.words().advantage([*before, *tokens, following[0] if following else ""], of_file)
        inside = np.flatnonzero(field.open(above, following is None)).tolist()
        if inside:
            found = WORD.finditer(text, start, end)
            i = -1
            for k in inside:
                m = next(itertools.islice(found, k - i - 1, None))
                i = k
                yield n + k, m.start(), m.end(), above[k]
        n += len(tokens)
        before = [*before, *tokens[-BACK:]][-BACK:]


def field_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans that the field finds: the best path through all tokens."""
    out: list[tuple[int, int, int]] = []
    for _, run in itertools.groupby(enumerate(open_tokens(text, field)), lambda x: x[1][0] - x[0]):
        tokens = [token for _, token in run]
        emit = np.zeros((len(tokens), 3))
        emit[:, 1:] = [token[3] for token in tokens]
        for (_, a, b, _), label in zip(tokens, field.best_path(emit), strict=True):
            if label == BEGIN:
                out.append((a, 3, b))
            elif label == INSIDE:
                out[-1] = (out[-1][0], 3, b)
    return out


def scan_text(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    new, at, reach = [], 0, -1
    for span in field_spans(text, field):  # both lists rise, so one walk tells which new spans touch no base span
        while at < len(base) and base[at][0] < span[2]:
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= span[0]:
            new.append(span)
    return base, sorted(base + new)


def sample(docs: DataFrame) -> list[str]:
    """At most SAMPLE whole texts: those of the least hashes of doc_id and text, however the rows lie."""
    n = docs.count()
    share = min(1.0, 2 * SAMPLE / n) if n else 1.0
    rows = docs.select("text", F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(SEED)).alias("h"))
    rows = rows.filter((F.pmod("h", F.lit(1 << 30)) < max(int(share * (1 << 30)), 1)) & (F.length("text") <= SAMPLE_CHARS))
    return sorted(r.text for r in rows.orderBy(F.pmod("h", F.lit(1 << 30)), "h", "text").limit(SAMPLE).select("text").collect())


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """Counts and digest of base spans, and all spans, of every row."""
    spark = common.bounded_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1):
                base, every = scan_text(text.as_py() or "", shared.value)
                kinds = [k for _, k, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(rendered(base).encode()).hexdigest(), rendered(every)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[x.split(" ")[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.tidy(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scan(docs, train(sample(docs)))
