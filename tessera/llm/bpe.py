"""Byte-pair encoding and decoding with a given vocabulary, in batched numpy merge rounds.

Each task reads the vocabulary file once. Texts are cut into words by the vocabulary's pattern; words that a task has
not met yet are encoded together: all their symbols lie in one flat array, every round looks each adjacent pair up by
binary search among the sorted pair keys, and merges each word's lowest-ranked pair wherever it doesn't overlap the one
just merged. No shuffle, and no state beyond a bounded cache of words.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_and_text, per_group, per_row

#: The word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 100_000
#: Words are encoded in groups of so many symbols at most, or one word that is longer.
GROUP_SYMBOLS = 1 << 18
#: A text is cut into words in slices of so many words, so a very long one isn't held as one list.
SLICE_WORDS = 1 << 16


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """Vocabulary, merges and added tokens of a tokenizers JSON file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec.get("normalizer") or pre["add_prefix_space"] or not pre["use_regex"] or model.get("ignore_merges") or model.get("dropout") or model.get("unk_token"):
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1]))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.made_of_rank = made
        pieces = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or match whole words only aren't supported")
        pieces |= {i: token.encode() for token, i in self.added.items()}
        self.piece_len = np.array([len(pieces.get(i, b"")) for i in range(self.size)], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])
        self.piece_bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(self.size)), np.uint8)
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.forget()

    def forget(self) -> None:
        """Empty the cache: word -> row, and by row where its ids start in ``flat`` and how many they are."""
        self.cache: dict[str, int] = {}
        self.flat, self.start, self.length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word after the other, and how many each has; one round of numpy calls merges one pair kind in each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_ids: list[np.ndarray] = []
        done_owner: list[np.ndarray] = []
        none = len(self.keys)
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == none] = 0
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.rank[at], none)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(np.concatenate([rank, [none]]), starts)
            counts = np.diff(np.concatenate([starts, [len(symbols)]]))
            best_here = np.repeat(best, counts)
            over = best_here == none
            if over.any():
                done_ids.append(symbols[over])
                done_owner.append(owner[over])
                live = ~over
                hit = np.concatenate([rank == best_here[:-1], [False]])[live]
                symbols, owner, best_here = symbols[live], owner[live], best_here[live]
            else:
                hit = np.concatenate([rank == best_here[:-1], [False]])
            if not len(symbols):
                break
            # In a run of overlapping hits (a a a a) every second one merges, from the left.
            run_start = hit & ~np.concatenate([[False], hit[:-1]])
            index = np.arange(len(hit))
            since = index - np.maximum.accumulate(np.where(run_start, index, 0))
            hit &= since % 2 == 0
            symbols = np.where(hit, self.made_of_rank[np.minimum(best_here, none - 1)], symbols)
            stay = ~np.concatenate([[False], hit[:-1]])
            symbols, owner = symbols[stay], owner[stay]
        done_ids.append(symbols)
        done_owner.append(owner)
        ids, owners = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owners, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(owners, minlength=len(words))

    def learn(self, new: list[str]) -> None:
        """Encode the words that aren't in the cache yet."""
        part: list[bytes] = []
        size = 0
        flat, length = [self.flat], [self.length]
        for i, word in enumerate(new):
            self.cache[word] = len(self.cache)
            part.append(word.encode())
            size += len(part[-1])
            if size >= GROUP_SYMBOLS or i == len(new) - 1:
                for out, x in zip((flat, length), self.merge(part), strict=True):
                    out.append(x)
                part, size = [], 0
        self.flat, self.length = np.concatenate(flat), np.concatenate(length)
        self.start = np.cumsum(self.length) - self.length

    def words_ids(self, words: list[str]) -> np.ndarray:
        """Ids of words that are all in the cache, one word after the other."""
        rows = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        lengths = self.length[rows]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.start[rows] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """A text as lists of words, a long one in several, and the ids of added tokens between them."""
        for piece in self.split.split(text) if self.split and any(t in text for t in self.added) else [text]:
            if piece in self.added:
                yield self.added[piece]
            elif len(piece) <= SLICE_WORDS * 4:
                yield self.words.findall(piece)
            else:
                found = self.words.finditer(piece)
                while words := [m.group() for m in itertools.islice(found, SLICE_WORDS)]:
                    yield words

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Short texts are encoded together, so that their new words share the merge rounds."""
        out = []
        for group in bounded(texts, SLICE_WORDS * 4):
            if len(group) == 1:
                out.append(self.encode(group[0]))
                continue
            parts = [list(self.pieces(text)) for text in group]
            self.learn_from(w for part in parts for words in part if isinstance(words, list) for w in words)
            out.extend(joined([np.array([p], np.uint32) if isinstance(p, int) else self.words_ids(p) for p in part]) for part in parts)
        return out

    def learn_from(self, words: Iterable[str]) -> None:
        words = dict.fromkeys(words)
        if len(self.cache) > CACHE_WORDS:
            self.forget()
        if new := [w for w in words if w not in self.cache]:
            self.learn(new)

    def encode(self, text: str) -> np.ndarray:
        parts: list[np.ndarray] = []
        for piece in self.pieces(text):
            if isinstance(piece, int):
                parts.append(np.array([piece], np.uint32))
            else:
                self.learn_from(piece)
                parts.append(self.words_ids(piece))
        return joined(parts)

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.astype(np.int64)
        lengths = self.piece_len[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        from_ = np.repeat(self.piece_at[ids] - (ends - lengths), lengths) + np.arange(total)
        return self.piece_bytes[from_].tobytes().decode("utf-8", "replace")


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def bounded(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in groups of at most ``chars`` characters, or one that is longer."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (the tokens as little-endian unsigned 32-bit integers), n_tokens.

    Null and empty texts have no tokens. Repeated rows give repeated results; an empty table gives an empty one. The
    length of a text isn't bounded. ``vocabulary`` is a path that every executor can open, as installed with its library.
    """

    def make():
        bpe = ByteBPE(vocabulary)

        return lambda texts: [(ids.astype("<u4").tobytes(), len(ids)) for ids in bpe.encode_all([t or "" for t in texts])]

    return per_group(id_and_text(docs, id_col, text_col), make, [("ids", T.BinaryType()), ("n_tokens", T.LongType())])


def bpe_decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """doc_id and text of what ``bpe_encode`` returned; null ids give the empty text, ids outside the vocabulary fail."""

    def make():
        bpe = ByteBPE(vocabulary)
        return lambda ids: (bpe.decode(np.frombuffer(ids or b"", "<u4")),)

    return per_row(encoded.select("doc_id", F.col(ids_col).alias("text")), make, [("decoded", T.StringType())]).withColumnRenamed("decoded", "text")


def bpe_round_trip(docs: DataFrame, vocabulary: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids: encodes and decodes each text in one pass."""

    def make():
        bpe = ByteBPE(vocabulary)

        def of(texts: list[str | None]) -> list[tuple]:
            out = []
            for found in bpe.encode_all([t or "" for t in texts]):
                data = found.astype("<u4").tobytes()
                out.append((len(found), hashlib.sha256(data).hexdigest(), hashlib.sha256(bpe.decode(found).encode()).hexdigest(), *([data] if ids else [])))
            return out

        return of

    return per_group(id_and_text(docs), make, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), *([("ids", T.BinaryType())] if ids else [])])
