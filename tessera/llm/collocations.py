"""Phrase collocation mining: candidates from a sketch, counted exactly by Aho-Corasick automata, then scored relationally.

0. Texts are cut into words once and written as numbers of their words, which all passes read.
1. A sketch, one row of counters, counts all word pairs by hash: a counter is an upper bound of how often any of its pairs
   occurs. Longer phrases are counted in a second one, if each pair in them may be frequent.
2. Phrases whose bound reaches the threshold are the candidates. A bound is never too low, so none is missed.
3. Candidates and the words in them become patterns in automata whose letters are whole words, as arrays; the patterns of a
   scan hold a bounded number of bytes. Tasks put their pieces through, many at a time, and count the states that are met; a
   state's matches are its own and those of all that fail to it, so overlapping ones count too. Counts are added, and only
   then do thresholds, scores and the dropping of parts of longer phrases apply.

The sketch only saves work: its width follows the corpus up to a bound, beyond which more false candidates are counted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WordHash, grouped, rolling, scramble, stored

LONGEST, LEAST, TOP, SHARE = 5, 100, 2000, 100
#: Counters of a sketch as powers of two: one for about 16 bytes of words, within these; and of a slab, whose counters one task adds.
FEWEST_BITS, MOST_BITS, SLAB_BITS, BYTES_A_COUNTER = 18, 28, 18, 16
#: Tasks among which the rows of one slab are dealt first, n-grams that are held before they are counted, characters taken at once.
LANES, HELD, CHARS = 16, 4_000_000, 1 << 20
#: Bytes of candidates that a task holds before it sends them and of those in the automata of one scan, patterns whose counts
#: travel in one row, words of a piece that are put through an automaton at a time.
HELD_BYTES, SCAN_BYTES, COUNTED, RUN = 24_000_000, 96_000_000, 1024, 64
#: Languages whose sizes are broadcast; of more they are joined by language.
FEW = 10_000
#: What ends a piece, and the name of rows without language.
ENDS, NO_LANG = b".,;:!?\n\v\f\r", "und"
FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)) + b"\t" + ENDS, bytes(range(0x61, 0x7B)) + b" " + b"\n" * len(ENDS))


def pieces_of(text: str | None) -> list[list[bytes]]:
    """The words of each piece of a text that has any."""
    return [w for piece in (text or "").encode("utf-8", "replace").translate(FOLD).split(b"\n") if (w := piece.split())]


def chunks(batches: Iterable[pa.RecordBatch], chars: int = CHARS) -> Iterator[tuple[str, list[list[bytes]]]]:
    """Language and pieces of texts of that language, about ``chars`` characters of them together."""
    held: dict[str, list[list[bytes]]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            held.setdefault(lang, []).extend(pieces_of(text))
            size[lang] = size.get(lang, 0) + len(text or "")
            if size[lang] >= chars:
                yield lang, held.pop(lang)
                del size[lang]
            elif sum(size.values()) >= 4 * chars or len(held) > 1000:
                yield from held.items()
                held, size = {}, {}
    yield from held.items()


class Numbered(dict):
    """Words by number, in the order in which they are asked for first."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """A chunk's different words, the place in them of each word that stands in it, and how many words each piece has."""

    def __init__(self, words: list[bytes], at: np.ndarray, sizes: np.ndarray):
        self.words, self.at, self.sizes = words, at, sizes

    @classmethod
    def of(cls, pieces: list[list[bytes]]) -> Words:
        numbers, sizes = Numbered(), np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(pieces)), np.int64, sizes.sum())
        return cls(list(numbers), at, sizes)

    def phrases(self, at: np.ndarray, order: int) -> Iterator[bytes]:
        """Those of ``order`` words that begin at some places."""
        return map(b" ".join, zip(*(map(self.words.__getitem__, self.at[at + i].tolist()) for i in range(order)), strict=True))


def worded(docs: DataFrame) -> DataFrame:
    """lang, words, at, sizes and bytes: each chunk's ``Words``, so that texts are cut into words once and not in every pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, pieces in chunks(batches):
            if pieces:
                w = Words.of(pieces)
                size = int(np.fromiter(map(len, w.words), np.int64, len(w.words))[w.at].sum()) + len(w.at)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *(pa.array([x], pa.binary()) for x in (zstandard.compress(b"\n".join(w.words), 1), packed(w.at), packed(w.sizes))), pa.array([size], pa.int64())], ["lang", "words", "at", "sizes", "bytes"])

    return docs.mapInArrow(run, "lang string, words binary, at binary, sizes binary, bytes long")


def words_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """Language and words of the chunks of texts (lang, text), or of those that ``worded`` has made of them."""

    def texts(first: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield first.pop()
        yield from batches

    batches = iter(batches)
    for batch in batches:
        if batch.num_columns == 2:
            yield from ((lang, Words.of(pieces)) for lang, pieces in chunks(texts([batch])))
            return
        for lang, words, at, sizes in zip(*batch.columns[:4], strict=True):
            yield lang.as_py(), Words(zstandard.decompress(words.as_py()).split(b"\n"), unpacked(at.as_py()).astype(np.int64), unpacked(sizes.as_py()).astype(np.int64))


class Grams:
    """Hashes of the n-grams within the pieces of a chunk."""

    def __init__(self, hashes: WordHash, lang: str, pieces: Words | list[list[bytes]]):
        self.words = pieces if isinstance(pieces, Words) else Words.of(pieces)
        self.hash, self.salt = hashes.of(self.words.words)[self.words.at], np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace")))
        counts = self.words.sizes
        #: How many words of its piece each word has from itself on.
        self.room = np.repeat(np.cumsum(counts), counts) - np.arange(len(self.hash))

    def of(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the n-gram that begins at each place, and whether there is one in its piece."""
        h = scramble(rolling(self.hash, order) ^ self.salt)
        return h, self.room[: len(h)] >= order


class Bits:
    """Which counters of a sketch reach a threshold: one bit each."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def has(self, h: np.ndarray) -> np.ndarray:
        b = h >> np.uint64(64 - self.bits)
        return (self.packed[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def pairs_held(grams: Grams, pairs: Bits) -> np.ndarray:
    h, whole = grams.of(2)
    return whole & pairs.has(h)


def longer(grams: Grams, pairs: Bits, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Order, hashes and places of the n-grams of three words and more whose pairs may all be frequent."""
    held = pairs_held(grams, pairs)
    for order in range(3, longest + 1):
        h, whole = grams.of(order)
        for i in range(order - 1):
            whole = whole & held[i : i + len(h)]
        at = np.flatnonzero(whole)
        yield order, h[at], at


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, first bytes first, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def sketch(docs: DataFrame, bits: int, least: int, longest: int, pairs: Bits | None = None) -> Bits:
    """Counters of pairs, or with ``pairs`` of longer n-grams, that reach ``least``. What the driver gets is a bit a counter.

    Tasks send counters that they have met, by slab; slabs are added by several tasks first and by one then, row by row.
    """
    session = docs.sparkSession.sparkContext
    sent = session.broadcast((pairs.bits, pairs.packed)) if pairs else None
    slabs, rest = 1 << (bits - SLAB_BITS), 1 << SLAB_BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, filter_, lane = WordHash(), Bits(*sent.value) if sent else None, TaskContext.get().partitionId() % LANES
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            at, times = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(at, np.arange(slabs + 1, dtype=np.uint64) << np.uint64(SLAB_BITS))
            rows = [(s, packed(np.diff(at[a:b] - np.uint64(s << SLAB_BITS), prepend=np.uint64(0))), packed(times[a:b])) for s, (a, b) in enumerate(itertools.pairwise(cuts)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([lane] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["slab", "lane", "at", "times"])

        for lang, words in words_of(batches):
            grams = Grams(hashes, lang, words)
            if filter_:
                found = [h for _, h, _ in longer(grams, filter_, longest)]
            else:
                h, whole = grams.of(2)
                found = [h[whole]]
            for h in found:
                held.append(h >> np.uint64(64 - bits))
                size += len(h)
            if size >= HELD:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for slab, lane, at, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (slab, lane):
                    if key:
                        yield from whole_slab(*key, total)
                    key, total = (slab, lane), np.zeros(rest, np.int64)
                total[np.cumsum(unpacked(at), dtype=np.int64)] += unpacked(times)
        if key:
            yield from whole_slab(*key, total)

    def whole_slab(slab: int, lane: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A lane's counts; a threshold holds for any count beyond it, so they are cut there and stay small."""
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([slab], pa.int32()), pa.array([0], pa.int32()), pa.array([packed(np.diff(at, prepend=0))], pa.binary()), pa.array([packed(np.minimum(total[at], least))], pa.binary())], ["slab", "lane", "at", "times"])

    def reached(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in added(batches):
            flags = np.zeros(rest, bool)
            flags[np.cumsum(unpacked(batch.column(2)[0].as_py()), dtype=np.int64)] = unpacked(batch.column(3)[0].as_py()) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["slab", "bits"])

    form = "slab int, lane int, at binary, times binary"
    rows = docs.mapInArrow(run, form).repartition("slab", "lane").sortWithinPartitions("slab", "lane").mapInArrow(added, form)
    flags = rows.repartition("slab").sortWithinPartitions("slab").mapInArrow(reached, "slab int, bits binary")
    out = np.zeros((slabs, rest >> 3), np.uint8)
    for r in flags.toLocalIterator():  # at most 2 ** MOST_BITS bits in all
        out[r["slab"]] = np.frombuffer(r["bits"], np.uint8)
    return Bits(bits, out.reshape(-1))


class Met:
    """A growing set of hashes in sorted arrays, each over twice as long as the next: what is added is merged with shorter ones
    only, so that a chunk's hashes don't cost as much as all that were met before."""

    def __init__(self):
        self.runs: list[np.ndarray] = []

    def __len__(self) -> int:
        return sum(map(len, self.runs))

    def has(self, h: np.ndarray) -> np.ndarray:
        """Of sorted hashes."""
        out = np.zeros(len(h), bool)
        for run in self.runs:
            out |= run[np.minimum(np.searchsorted(run, h), len(run) - 1)] == h
        return out

    def add(self, h: np.ndarray) -> None:
        """Hashes that aren't in the set, in any order."""
        if len(h):
            self.runs.append(np.unique(h))
        while len(self.runs) > 1 and len(self.runs[-2]) <= 2 * len(self.runs[-1]):
            last = self.runs.pop()
            self.runs[-1] = np.sort(np.concatenate([self.runs[-1], last]), kind="stable")


def parts_of(bits: int) -> int:
    """Into how many parts the candidates of a language are dealt: more with a wider sketch."""
    return 1 << max(4, bits - SLAB_BITS)


def candidates(docs: DataFrame, pairs: Bits, more: Bits, longest: int) -> DataFrame:
    """lang, phrase and n: phrases whose bounds reach the threshold, once each; '' has the number of the language's words.

    Tasks tell a phrase once, in blocks by language and part of the hash space; a part of the tasks' blocks becomes one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(((pairs.bits, pairs.packed), (more.bits, more.packed)))
    parts = parts_of(pairs.bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, rest = (Bits(*x) for x in sent.value)
        hashes, met, words, held, size = WordHash(), Met(), {}, {}, 0
        for lang, chunk in words_of(batches):
            grams = Grams(hashes, lang, chunk)
            words[lang] = words.get(lang, 0) + len(chunk.at)
            h, _ = grams.of(2)
            at = np.flatnonzero(pairs_held(grams, two))
            found = [(2, h[at], at)]
            for order, h, at in longer(grams, two, longest):
                ok = rest.has(h)
                found.append((order, h[ok], at[ok]))
            new = []
            for order, h, at in found:
                h, first = np.unique(h ^ np.uint64(order), return_index=True)
                fresh = ~met.has(h)
                new.append(h[fresh])
                for x, phrase in zip((h[fresh] % np.uint64(parts)).tolist(), chunk.phrases(at[first[fresh]], order), strict=True):
                    held.setdefault((lang, x), []).append(phrase)
                    size += len(phrase)
            met.add(np.concatenate(new))
            if len(met) > HELD or size > HELD_BYTES:  # a phrase may be told twice, but what is held is bounded
                yield from blocks(held)
                met, held, size = Met(), {}, 0
        yield from blocks(held)
        yield from blocks({(lang, -1): [b"%d" % n] for lang, n in words.items()})

    def blocks(held: dict[tuple[str, int], list[bytes]]) -> Iterator[pa.RecordBatch]:
        for some in grouped(held.items(), 256):
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in some], pa.string()), pa.array([k[1] for k, _ in some], pa.int32()), pa.array([zstandard.compress(b"\n".join(sorted(v)), 1) for _, v in some], pa.binary())], ["lang", "part", "block"])

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, set()
        for batch in batches:
            for lang, part, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (lang, part):
                    yield from told(key, seen)
                    key, seen = (lang, part), set()
                lines = zstandard.decompress(block).split(b"\n")
                seen = {sum(map(int, [*seen, *lines]))} if part < 0 else seen.union(lines)
        yield from told(key, seen)

    def told(key: tuple[str, int] | None, seen: set) -> Iterator[pa.RecordBatch]:
        for some in grouped(seen, 50_000):
            n = len(some)
            phrases = [""] * n if key[1] < 0 else [x.decode("utf-8", "replace") for x in some]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array(phrases, pa.string()), pa.array(some if key[1] < 0 else [0] * n, pa.int64())], ["lang", "phrase", "n"])

    rows = docs.mapInArrow(run, "lang string, part int, block binary")
    return rows.repartition("lang", "part").sortWithinPartitions("lang", "part").mapInArrow(once, "lang string, phrase string, n long")


class Places(dict):
    """The number of each word; -1 of others."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Automaton:
    """An Aho-Corasick automaton over words, as arrays: the states after one word are the words' numbers, those after more are in
    the order of ``keys``, each the state before and the word read. -1 is the start, and what a state of one word fails to."""

    def __init__(self, patterns: pa.Array):
        lists = pc.split_pattern(patterns, " ")
        each, size = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy(zero_copy_only=False)
        read, first = each.indices.to_numpy(zero_copy_only=False).astype(np.uint64), np.cumsum(size) - size
        self.words, self.longest, keys = each.dictionary, int(size.max(initial=1)), []
        state, n = read[first].astype(np.int64), len(self.words)
        for k in range(1, self.longest):
            more = np.flatnonzero(size > k)
            made, at = np.unique(state[more].astype(np.uint64) << np.uint64(32) | read[first[more] + k], return_inverse=True)
            keys.append(made)
            state[more] = n + at
            n += len(made)
        #: The states in which patterns end, which of ``keys`` have the same number of words, and what each state fails to.
        self.ends, self.depths, self.keys = state, np.cumsum([0, *map(len, keys)]), np.concatenate([np.empty(0, np.uint64), *keys])
        self.fail = np.full(n, -1, np.int64)
        for a, b in itertools.pairwise(self.depths):
            key = self.keys[a:b]
            self.fail[len(self.words) + a : len(self.words) + b] = self.after(self.fail[(key >> np.uint64(32)).astype(np.int64)], (key & np.uint64(0xFFFFFFFF)).astype(np.int64))

    def after(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state after each of some has read a word (-1: one in no pattern)."""
        out, left = word.copy(), np.flatnonzero((state >= 0) & (word >= 0) & (len(self.keys) > 0))
        state, word = state[left], word[left].astype(np.uint64)
        while len(left):
            key = state.astype(np.uint64) << np.uint64(32) | word
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[left[found]] = len(self.words) + at[found]
            state = self.fail[state]
            rest = ~found & (state >= 0)
            left, state, word = left[rest], state[rest], word[rest]
        return out

    def states(self, word: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The state at each word of pieces of ``sizes`` words. Pieces are cut into runs, which all advance together; a run begins
        so many words earlier that whatever ends in it is known."""
        n = -(-sizes // RUN)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first, end = np.repeat(np.cumsum(sizes) - sizes, n), np.repeat(np.cumsum(sizes), n)
        at, end = first + k * RUN, np.minimum(first + (k + 1) * RUN, end)
        begin = np.maximum(first, at - (self.longest - 1))
        order = np.argsort(begin - end, kind="stable")
        at, begin, end = at[order], begin[order], end[order]
        longer = len(end) - np.searchsorted(np.sort(end - begin), np.arange(RUN + self.longest), side="right")  # than so many words
        out, state = np.full(len(word), -1, np.int64), np.full(len(at), -1, np.int64)
        for t, m in enumerate(longer.tolist()):
            if not m:
                break
            place = begin[:m] + t
            state = self.after(state[:m], word[place])
            own = place >= at[:m]
            out[place[own]] = state[own]
        return out

    def counts(self, visits: np.ndarray) -> np.ndarray:
        """How often each pattern occurs, of how often each state was met."""
        total = visits.copy()
        for a, b in reversed(list(itertools.pairwise(self.depths + len(self.words)))):
            np.add.at(total, self.fail[a:b][self.fail[a:b] >= 0], total[a:b][self.fail[a:b] >= 0])
        return total[self.ends]


def occurrences(docs: DataFrame, patterns: DataFrame, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """lang, phrase and f (all places, overlapping ones too) of each of ``patterns`` (lang, phrase) that stands anywhere.

    Patterns are dealt by hash to scans of about ``scan_bytes``; each scan reads the texts of the languages that it is for.
    """
    session = docs.sparkSession.sparkContext
    scans = max(1, -(-(patterns.agg(F.sum(F.octet_length("phrase") + 8)).first()[0] or 0) // scan_bytes))
    counted = None
    for s in range(scans):
        rows = patterns.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(scans)) == s).toArrow()  # scan_bytes in all
        of = {x: rows.filter(pc.equal(rows["lang"], x))["phrase"].combine_chunks() for x in pc.unique(rows["lang"]).to_pylist()}
        sent, told = session.broadcast({lang: Automaton(phrases) for lang, phrases in of.items()}), session.broadcast(of)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automata, places, visits, met, size = sent.value, {}, {}, {}, 0

            def added() -> None:
                for lang, states in met.items():
                    visits[lang] = visits.get(lang, 0) + np.bincount(np.concatenate(states), minlength=len(automata[lang].fail))

            for lang, words in words_of(batches):
                if lang not in automata:
                    continue
                if lang not in places:
                    places[lang] = Places(zip((w.encode() for w in automata[lang].words.to_pylist()), itertools.count()))
                known = np.fromiter(map(places[lang].__getitem__, words.words), np.int64, len(words.words))
                states = automata[lang].states(known[words.at], words.sizes)
                met.setdefault(lang, []).append(states[states >= 0])
                size += len(states)
                if size > HELD:
                    added()
                    met, size = {}, 0
            added()
            for lang, seen in visits.items():
                total = automata[lang].counts(seen)
                slabs = [(k, total[k * COUNTED : (k + 1) * COUNTED]) for k in range(-(-len(total) // COUNTED))]
                slabs = [(k, zstandard.compress(c.astype("<i8").tobytes(), 1)) for k, c in slabs if c.any()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slabs), pa.string()), pa.array([k for k, _ in slabs], pa.int32()), pa.array([c for _, c in slabs], pa.binary())], ["lang", "slab", "counts"])

        def added(batches: Iterable[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            key, total = None, 0
            for batch in batches:
                for lang, slab, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key not in (None, (lang, slab)):
                        yield named(told, *key, total)
                        total = 0
                    key, total = (lang, slab), total + np.frombuffer(zstandard.decompress(counts), "<i8")
            if key:
                yield named(told, *key, total)

        def named(told, lang: str, slab: int, total: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), told.value[lang].take(pa.array(slab * COUNTED + at)).cast(pa.string()), pa.array(total[at], pa.int64())], ["lang", "phrase", "f"])

        sums = docs.mapInArrow(run, "lang string, slab int, counts binary").repartition("lang", "slab").sortWithinPartitions("lang", "slab")
        found = sums.mapInArrow(added, "lang string, phrase string, f long")
        found = stored(found, "occurrences")
        counted = found if counted is None else counted.unionByName(found)
    return counted


def exact(*factors: Column) -> Column:
    """A product beyond 64 bits: 38 digits, more are an error."""
    out = factors[0].cast("decimal(19,0)")
    for f in factors[1:]:
        out = (out * f.cast("decimal(19,0)")).cast("decimal(38,0)")
    return out


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, share: int = SHARE, bits: int | None = None, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's ``top`` phrases of 2 to ``longest`` words with ``least`` places.

    ``a`` counts a phrase's places, ``n`` the language's words. Cut after its first k words a phrase's parts have ``l`` and
    ``r`` places, and the score is floor(1000 a n / (l r)); of all cuts the lowest counts, then that of least k. A phrase
    that stands inside a longer one which has ``share`` per cent of its places or more is dropped. Order: score and a from
    above, then the phrase's bytes.

    Null and empty texts have no words; rows of null ``lang`` are of the language ``und``, with those so named. Repeated
    rows count as often as they stand, ids play no part. A text's length isn't bounded, but one text is handled by one
    task. Other columns are ignored; an empty table gives an empty one. Scores are exact up to 38 digits of products, beyond
    which the query fails. N-grams are told apart by 64-bit hashes when candidates are gathered, by letters when counted.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    cut = stored(worded(docs), "words")
    docs = cut.drop("bytes")
    if bits is None:
        size = cut.agg(F.sum("bytes")).first()[0] or 0
        bits = min(MOST_BITS, max(FEWEST_BITS, (size // BYTES_A_COUNTER).bit_length()))
    pairs = sketch(docs, bits, least, longest)
    more = sketch(docs, bits, least, longest, pairs)
    met = stored(candidates(docs, pairs, more, longest), "candidates")
    phrases, sizes = met.where("phrase <> ''").select("lang", "phrase"), met.where("phrase = ''").select("lang", "n")
    sizes = F.broadcast(sizes) if sizes.limit(FEW + 1).count() <= FEW else sizes
    words = phrases.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct()
    f = occurrences(docs, phrases.unionByName(words), scan_bytes)
    return scored(f, sizes, least, top, share)


def scored(f: DataFrame, sizes: DataFrame, least: int, top: int, share: int) -> DataFrame:
    """Thresholds, cuts, dropped parts and ranks over counted phrases ``f`` (lang, phrase, f) and ``sizes`` (lang, n)."""
    one = f.withColumn("_w", F.split("phrase", " "))
    found = one.where((F.size("_w") >= 2) & (F.col("f") >= least)).withColumnRenamed("f", "a")
    part = lambda a, n: F.array_join(F.slice("_w", a, n), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("_w") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("_w")).alias("rest"))
    of = lambda name, count: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    cuts = cuts.withColumn("_above", exact(F.col("a"), F.col("n"), F.lit(1000))).withColumn("_below", exact(F.col("l"), F.col("r"))).withColumn("score", F.expr("_above div _below"))
    low = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("low"))
    inner = found.where(F.size("_w") >= 3).withColumn("_n", F.explode(F.sequence(F.lit(2), F.size("_w") - 1)))
    inner = inner.withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1))).select("lang", part(F.col("_i"), F.col("_n")).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    kept = low.join(inner, ["lang", "phrase"], "left").where(F.col("_most").isNull() | (100 * F.col("_most") < share * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
