"""Byte-level BPE over whole texts, without a regular expression.

Code points become symbols (a class, and for white space and apostrophes what follows). A small
automaton says where a piece ends; each symbol is a function from state to state, functions
compose associatively, and so the states of a whole slice come from a blocked scan: all blocks
are scanned side by side, then their totals, then every place is applied to its block's start.
The pieces that result are looked up in a cache; pieces not yet known are merged together, one
merge per piece and round, as arrays. A token's bytes are a slice of the vocabulary, and with
them its offset in the text is kept, so that decoding is one gather.

Defined results: null and empty texts have no tokens; equal texts get equal ids; a piece of any
length is merged (long ones with a heap); texts are held one slice at a time. Columns besides
`doc_id` and `text` are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from kartoteka.llm.memory import lean
from kartoteka.llm.spans import Texts, slices

CACHED_PIECES, CACHED_BYTES = 250_000, 6 << 20  # of both, whichever is reached first
LONG_PIECE = 48  # bytes; longer ones are merged one by one

# Classes of code points. A white space is `WHITE` where another one or the end follows.
LETTER, NUMBER, OTHER, LAST_BLANK, LAST_WHITE, WHITE, SHORT, LONG = range(8)
# States: at the start of a piece, in a run, after a leading blank, in white space, one or two letters to come.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_WHITE, ONE_MORE, TWO_MORE = range(8)

# White space, and the letters after an apostrophe that belong to it.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHORT_ENDINGS = "stmd"
_LONG_ENDINGS = ("re", "ve", "ll")


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece starts at this symbol)."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return START, False
    if symbol in (SHORT, LONG):
        if state in (IN_OTHERS, AFTER_BLANK):
            return IN_OTHERS, False
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, WHITE: IN_WHITE}.get(symbol)
    if run is not None:
        return run, state != run and (state != AFTER_BLANK or symbol == WHITE)
    return (AFTER_BLANK if symbol == LAST_BLANK else START), True


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(composition of a known function with a symbol's, states of each function, where pieces start).

    Symbols 8 to 15 are the classes at the first place of a text: they forget the state.
    """
    def of(symbol: int) -> tuple[int, ...]:
        return tuple(_step(START if symbol > 7 else state, symbol % 8)[0] for state in range(8))

    symbols = [of(s) for s in range(16)]
    known: dict[tuple[int, ...], int] = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *symbols]))}
    queue, rows = list(known), []
    for f in queue:
        row = []
        for g in symbols:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
            row.append(known[h])
        rows.append(row)
    starts = np.array([[_step(START if s > 7 else state, s % 8)[1] for s in range(16)] for state in range(8)])
    return np.array(rows, np.uint16), np.array(queue, np.uint8), starts


_COMPOSE, _APPLY, _STARTS = _automaton()


def scan_states(symbols: np.ndarray, block: int = 256) -> np.ndarray:
    """The state before each symbol."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.uint8)
    blocks = -(-n // block)
    grid = np.full(blocks * block, 0, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, block).T)
    prefix = np.zeros((block + 1, blocks), np.uint16)  # function 0 changes nothing
    for k in range(block):
        prefix[k + 1] = _COMPOSE[prefix[k], grid[k]]
    begin = np.zeros(blocks, np.uint8)
    state = START
    for b, total in enumerate(prefix[-1].tolist()):
        begin[b] = state
        state = _APPLY[total, state]
    return _APPLY[prefix[:-1], begin[None, :]].T.reshape(-1)[:n]


def code_point_classes() -> np.ndarray:
    """Letter, number, white space or other for every code point, by its general category."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[_WHITE_SPACE] = WHITE
    return out


def _symbols(points: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    n = len(points)
    out = classes[points]
    last = np.zeros(n, bool)  # of its text
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    follows = np.zeros(n, bool)  # something that is no white space
    follows[:-1] = out[1:] != WHITE
    follows &= ~last
    white = out == WHITE
    apostrophe = np.flatnonzero((points == ord("'")) & ~last)
    if len(apostrophe):
        after = points[apostrophe + 1]
        out[apostrophe[np.isin(after, [ord(c) for c in _SHORT_ENDINGS])]] = SHORT
        two = apostrophe[~last[apostrophe + 1]]
        for a, b in _LONG_ENDINGS:
            out[two[(points[two + 1] == ord(a)) & (points[two + 2] == ord(b))]] = LONG
    out[white & follows] = LAST_WHITE
    out[white & follows & (points == 32)] = LAST_BLANK
    first = bounds[:-1][bounds[1:] > bounds[:-1]]
    out[first] += 8
    return out


def piece_starts(texts: Texts, classes: np.ndarray) -> np.ndarray:
    """Where pieces start, in bytes; pieces reach up to the next one."""
    at = np.flatnonzero((texts.data & 0xC0) != 0x80)
    if not len(at):
        return at
    points = texts.data if len(at) == len(texts.data) else np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    bounds = np.searchsorted(at, texts.offsets)
    symbols = _symbols(points, bounds, classes)
    return at[_STARTS[scan_states(symbols), symbols]]


Vocabulary = dict[str, Any]


def _pair_table(pairs: Mapping[tuple[int, int], int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing: slots of (left * size + right) and of the merged id; -1 marks free ones."""
    bits = max(4, (3 * len(pairs)).bit_length())
    keys = np.full(1 << bits, -1, np.int64)
    values = np.zeros(1 << bits, np.int32)
    todo_keys = np.array([a * size + b for a, b in pairs], np.int64)
    todo_values = np.array(list(pairs.values()), np.int32)
    slots = _slot(todo_keys, bits)
    while len(todo_keys):
        _, chosen = np.unique(slots, return_index=True)
        chosen = chosen[keys[slots[chosen]] < 0]
        keys[slots[chosen]], values[slots[chosen]] = todo_keys[chosen], todo_values[chosen]
        left = np.ones(len(todo_keys), bool)
        left[chosen] = False
        todo_keys, todo_values, slots = todo_keys[left], todo_values[left], (slots[left] + 1) & ((1 << bits) - 1)
    return keys, values


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _vocabulary(tokens: Sequence[bytes], pairs: Mapping[tuple[int, int], int]) -> Vocabulary:
    keys, values = _pair_table(pairs, len(tokens))
    return {"tokens": list(tokens), "keys": keys, "values": values, "classes": code_point_classes()}


def read_ranks(path: str) -> Vocabulary:
    """A rank file: any two neighbours whose bytes together have a rank may merge, the lowest rank first."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks are not 0 to n")
    pairs = {(ranks[t[:k]], ranks[t[k:]]): rank for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
    return _vocabulary(tokens, pairs)


def _printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in vocabularies kept as JSON: printable ones for themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_merges(path: str) -> Vocabulary:
    """A tokenizer kept as JSON: the listed pairs merge, in their order."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    as_byte, ids = _printable_bytes(), model["vocab"]
    by_id = sorted(ids, key=ids.__getitem__)
    if [ids[t] for t in by_id] != list(range(len(by_id))):
        raise ValueError("ids are not 0 to n")
    tokens = [bytes(as_byte[c] for c in t) for t in by_id]
    pairs = {}
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        pairs.setdefault((ids[a], ids[b]), ids[a + b])
    if list(pairs.values()) != sorted(pairs.values()):
        raise ValueError("ids do not follow the order of merges")
    return _vocabulary(tokens, pairs)


_NONE = np.int32(2**31 - 1)


@dataclass
class Encoded:
    """Ids of the texts of a slice: text i has ids[bounds[i]:bounds[i + 1]], made of pieces[piece_bounds[i]:...]."""

    ids: np.ndarray
    bounds: np.ndarray
    pieces: np.ndarray
    piece_bounds: np.ndarray


class Encoder:
    """Encodes slices of texts with one vocabulary; known pieces stay in a cache of bounded size."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens: list[bytes] = vocabulary["tokens"]
        self.size = len(self.tokens)
        self.keys, self.values, self.classes = vocabulary["keys"], vocabulary["values"], vocabulary["classes"]
        self.bits = len(self.keys).bit_length() - 1
        single = {t: i for i, t in enumerate(self.tokens) if len(t) == 1}
        self.byte_ids = np.array([single[bytes([b])] for b in range(256)], np.int32)
        self.token_sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.token_starts = np.concatenate([[0], np.cumsum(self.token_sizes)])
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.texts: list[bytes] = []  # decimal ids of a piece, joined by commas
        self.counts = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.used = 0
        self.cached_bytes = 0

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that two neighbours merge into, or `_NONE`."""
        keys = left.astype(np.int64) * self.size + right
        out = np.full(len(keys), _NONE, np.int32)
        slots, todo = _slot(keys, self.bits), np.arange(len(keys))
        while len(todo):
            there = self.keys[slots]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slots[hit]]
            more = ~hit & (there >= 0)
            todo, slots = todo[more], (slots[more] + 1) & (len(self.keys) - 1)
        return out

    def _merge_short(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each)."""
        lengths = np.array([len(w) for w in words])
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        merged = np.full(len(ids), _NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        merged[inner] = self.lookup(ids[inner], ids[inner + 1])
        done_ids, done_words = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(ids)]]))
            lowest = np.minimum.reduceat(merged, starts)
            going = np.repeat(lowest < _NONE, sizes)
            if not going.all():
                done_ids.append(ids[~going])
                done_words.append(word[~going])
                lowest, sizes = lowest[lowest < _NONE], sizes[lowest < _NONE]
                ids, word, merged = ids[going], word[going], merged[going]
                if not len(ids):
                    break
            hits = np.flatnonzero(merged == np.repeat(lowest, sizes))
            at = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]  # the leftmost of each word
            ids[at] = merged[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, merged = ids[keep], word[keep], merged[keep]
            at = at - np.arange(len(at))
            changed = np.concatenate([at, at[at > 0] - 1])
            merged[changed] = _NONE
            changed = changed[changed + 1 < len(ids)]
            changed = changed[word[changed] == word[changed + 1]]
            merged[changed] = self.lookup(ids[changed], ids[changed + 1])
        all_ids, all_words = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(all_words, kind="stable")
        return all_ids[order], np.bincount(all_words, minlength=len(words))

    def _merge_long(self, word: bytes) -> list[int]:
        """Merges of one long piece, by a heap of neighbours and a linked list."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        n = len(ids)
        first = self.lookup(ids[:-1], ids[1:])
        heap = [(int(r), i) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)
        ids = ids.tolist()
        rank = [*first.tolist(), int(_NONE)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        memo: dict[tuple[int, int], int] = {}

        def look(i: int) -> int:
            j = after[i]
            if j >= n:
                return int(_NONE)
            pair = (ids[i], ids[j])
            if pair not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[pair] = int(self.lookup(np.array([pair[0]]), np.array([pair[1]]))[0])
            return memo[pair]

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            ids[i], rank[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    rank[k] = look(k)
                    if rank[k] != _NONE:
                        heapq.heappush(heap, (rank[k], k))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _learn(self, words: Sequence[bytes]) -> None:
        short = [w for w in words if len(w) <= LONG_PIECE]
        groups = []
        if short:
            groups.append((short, *self._merge_short(short)))
        for w in words:
            if len(w) > LONG_PIECE:
                ids = self._merge_long(w)
                groups.append(([w], np.array(ids, np.int32), np.array([len(ids)])))
        for some, ids, counts in groups:
            at, total = len(self.cache), len(self.cache) + len(some)
            while total > len(self.counts):
                self.counts, self.starts = np.resize(self.counts, 2 * len(self.counts)), np.resize(self.starts, 2 * len(self.starts))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.counts[at:total] = counts
            self.starts[at:total] = self.used + np.cumsum(counts) - counts
            self.flat[self.used:self.used + len(ids)] = ids
            self.used += len(ids)
            self.cache.update(zip(some, range(at, total), strict=True))
            self.cached_bytes += sum(map(len, some))
            text, place = ids.tolist(), 0
            for n in counts.tolist():
                self.texts.append(",".join(map(str, text[place:place + n])).encode())
                place += n

    def encode(self, texts: Texts) -> Encoded:
        """Ids of every text of a slice."""
        starts = piece_starts(texts, self.classes)
        bounds = np.searchsorted(starts, texts.offsets)
        raw = texts.data.tobytes()
        cuts = [*starts.tolist(), len(raw)]
        words = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(self.cache) > CACHED_PIECES or self.cached_bytes > CACHED_BYTES:
            self._forget()
        pieces = np.fromiter(map(self.cache.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(pieces < 0).tolist()
        if unknown:
            self._learn(list(dict.fromkeys(words[i] for i in unknown)))
            pieces[unknown] = [self.cache[words[i]] for i in unknown]
        counts = self.counts[pieces]
        before = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.starts[pieces] - before[:-1], counts) + np.arange(before[-1])]
        return Encoded(ids, before[bounds], pieces, bounds)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts in the bytes of all ids, and the end."""
        return np.concatenate([[0], np.cumsum(self.token_sizes[ids])])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        sizes, ends = self.token_sizes[ids], self.offsets(ids)
        return self.token_bytes[np.repeat(self.token_starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])]


def shared_vocabulary(spark: SparkSession, vocabulary: Vocabulary) -> Broadcast:
    """The vocabulary for all tasks; its size is that of its file, whatever the input."""
    return spark.sparkContext.broadcast(vocabulary)


def encoder(shared: Broadcast) -> Encoder:
    """One encoder for each worker process, with the cache of its earlier tasks."""
    vocabulary = shared.value
    if "encoder" not in vocabulary:
        vocabulary["encoder"] = Encoder(vocabulary)
    return vocabulary["encoder"]


def map_encoded(docs: DataFrame, vocabulary: Vocabulary, make: Callable[[Encoder, Texts, Encoded], Iterable[pa.Array]], schema: str,
                rows: Callable[[Encoded], np.ndarray] | None = None) -> DataFrame:
    """doc_id and the columns that `make` derives from each encoded slice, a row for each text or for each place in `rows`."""
    shared = shared_vocabulary(docs.sparkSession, vocabulary)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared)
        for batch in batches:
            for texts in slices(batch.column(1)):
                encoded = own.encode(texts)
                ids = batch.column(0).slice(texts.first, len(texts))
                if rows is not None:
                    ids = ids.take(pa.array(rows(encoded)))
                yield pa.RecordBatch.from_arrays([ids, *make(own, texts, encoded)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, {schema}")


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def encode_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, `ids`, and `offsets`: where each token starts among the bytes of its text."""
    def make(own: Encoder, texts: Texts, encoded: Encoded) -> list[pa.Array]:
        at = own.offsets(encoded.ids)[:-1] - np.repeat(texts.offsets[:-1], np.diff(encoded.bounds))
        return [_lists(encoded.ids, encoded.bounds), _lists(at, encoded.bounds)]

    return map_encoded(docs, vocabulary, make, "ids array<int>, offsets array<int>")


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and the `text` of `ids`; null ids give an empty text."""
    shared = shared_vocabulary(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared)
        for batch in batches:
            texts = [own.decode(np.array(ids.as_py() or [], np.int64)).tobytes().decode("utf-8", "replace") for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lean(run), f"doc_id {kind}, text string")


def digest_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to."""
    def make(own: Encoder, texts: Texts, encoded: Encoded) -> list[pa.Array]:
        joined = list(map(own.texts.__getitem__, encoded.pieces.tolist()))
        ids = [hashlib.sha256(b",".join(joined[a:b])).hexdigest() for a, b in zip(encoded.piece_bounds, encoded.piece_bounds[1:])]
        raw, ends = own.decode(encoded.ids).tobytes(), own.offsets(encoded.ids)[encoded.bounds].tolist()
        decoded = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
        return [pa.array(np.diff(encoded.bounds), pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    return map_encoded(docs, vocabulary, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
