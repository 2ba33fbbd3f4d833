"""Texts as numbers of words: what a tokenizer that drops spaces and splits letters from marks needs to see once."""

from __future__ import annotations

import gc
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of one generation of a worker's cache, and characters of the longest that it keeps.
WORDS_CACHED, CACHED_CHARS = 400_000, 64
#: Bytes of text that are worked on at once, besides those of the last row.
PART_BYTES = 2 << 20


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """All texts in order, in parts of PART_BYTES: what is made of a part is several times its size."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PART_BYTES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        yield texts.slice(a, b - a)


def numbered(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each string, and the different strings by number."""
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's pieces start among all, the number of each piece, and the different pieces by number.

    Texts are cut at spaces and line ends; a null text is one empty piece. Splitting and numbering are Arrow's, so
    Python sees each different piece of a batch once.
    """
    cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    offsets = cut.offsets.to_numpy()
    return offsets - offsets[0], *numbered(cut.flatten())


#: Letters, then ASCII marks without the apostrophe, which may begin a word of letters.
MARKED = r"^(?P<word>\pL+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def unmarked(found: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """Pieces as words and the marks after them, both numbered. Words of ASCII letters are lower-cased.

    Pieces that aren't letters and then marks are words as they are, with no marks.
    """
    parts = pc.extract_regex(found, MARKED)
    plain = pc.is_valid(parts)
    word = pc.struct_field(parts, 0)
    word = pc.if_else(plain, pc.if_else(pc.string_is_ascii(word), pc.ascii_lower(word), word), found)
    return *numbered(word), *numbered(pc.if_else(plain, pc.struct_field(parts, 1), ""))


def spread(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all items of the coded entries, in order; entry k has sizes[k] items from starts[k] on."""
    n = sizes[codes]
    ends = np.cumsum(n)
    return np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class WordIds:
    """Ids of batches of texts. Subclasses say how new words are learnt; a cache of two generations keeps the rest.

    folds tells that ASCII letters may be lower-cased and letters split from the marks that follow them.
    """

    def __init__(self, folds: bool):
        self.folds = folds
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Put the ids of new words into young, as little-endian 32-bit integers."""
        raise NotImplementedError

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        if len(self.young) > WORDS_CACHED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for w in dict.fromkeys([words[i] for i in missing]):
            if (found := old.get(w)) is None:
                new.append(w)
            else:
                young[w] = found
        self.learn(new)
        for i in missing:
            out[i] = young[words[i]]
        for w in new:
            if len(w) > CACHED_CHARS:
                del young[w]
        return out

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, one after another, where each word's start, and how many they are."""
        found = self.known(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, sizes

    def of_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's pieces start, the number of each piece; all pieces' ids, where each one's start, how many."""
        gc.disable()  # the cache has no cycles, so it isn't searched for any meanwhile
        try:
            offsets, codes, found = pieces(texts)
            strings = lambda x: x.to_numpy(zero_copy_only=False).tolist()
            if not self.folds:
                return offsets, codes, *self.flat(strings(found))
            word, words, mark, marks = unmarked(found)
            every, starts, sizes = self.flat(strings(words) + strings(marks))
            both = np.column_stack((word, mark + len(words)))
            every, sizes = every[spread(both.ravel(), starts, sizes)], sizes[both].sum(axis=1)
            return offsets, codes, every, np.cumsum(sizes) - sizes, sizes
        finally:
            gc.enable()


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()
