"""Hashed word n-grams of a text, for models that learn from counts of hashed features.

A word is a run of characters other than ASCII white space. Each word gives two symbols: its core (letters and digits,
lower-cased) and its shape (case pattern and the punctuation around the core), so that marks such as ``***`` or capital
letters show whatever the word. The features are unigrams and bigrams of either kind of symbol; a word that equals the
one before it gives a symbol of its own instead of the bigram of cores.
"""

from __future__ import annotations

import numpy as np
import regex
import xxhash

from tessera.llm.common import MIX, scramble

MOST_WORDS = 200_000
EDGES = regex.compile(r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$", regex.S)
#: The same edges where all is ASCII.
MARKS = bytes(i for i in range(128) if not chr(i).isalnum())
#: Salts that keep the kinds of features apart.
CORE, SHAPE, CORES, SHAPES, SAME = (np.uint64(0x100000001B3 * (2 * i + 1)) for i in range(5))


def case_of(core: str) -> str:
    if not core:
        return "-"
    if core.isdigit():
        return "9"
    if len(core) > 1 and core.isupper():
        return "AA"
    return "Aa" if core[0].isupper() else "a" if core.islower() else "mixed"


def edges(word: bytes) -> tuple[str, str, str]:
    """What stands before a word's first letter or digit, from there to its last, and after; all in front if it has none."""
    if not word.isascii():
        return EDGES.match(word.decode("utf-8", "replace")).groups()
    left = word.lstrip(MARKS)
    core = left.rstrip(MARKS)
    return word[: len(word) - len(left)].decode(), core.decode(), left[len(core) :].decode()


class WordTable(dict):
    """A row for each word met: its core's and its shape's hash; rows are dropped all at once when there are too many."""

    def __init__(self):
        super().__init__()
        self.core = np.empty(1 << 12, np.uint64)
        self.shape = np.empty(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        row = len(self)
        if row == len(self.core):
            self.core = np.concatenate([self.core, np.empty_like(self.core)])
            self.shape = np.concatenate([self.shape, np.empty_like(self.shape)])
        before, core, after = edges(word)
        self.core[row] = xxhash.xxh3_64_intdigest(core.lower())
        self.shape[row] = xxhash.xxh3_64_intdigest(f"{before[:8]} {case_of(core)} {after[:8]}")
        self[word] = row
        return row

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def features(self, rows: np.ndarray) -> np.ndarray:
        """64-bit hashes of all n-grams of a text given by its words' rows; 4 n - 2 of them for n words."""
        if not len(rows):
            return np.empty(0, np.uint64)
        core, shape = self.core[rows], self.shape[rows]
        pair = core[:-1] * MIX + core[1:] + CORES
        pair[core[:-1] == core[1:]] = SAME
        return scramble(np.concatenate([core ^ CORE, shape ^ SHAPE, pair, shape[:-1] * MIX + shape[1:] + SHAPES]))
