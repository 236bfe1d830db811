"""Line dedup: passages that stand elsewhere already are taken out.

Texts are cut into lines, and lines after punctuation, as half of all texts are one line. A repeat
goes if it has `MIN_LINES` whole lines and `MIN_WORDS` words, if it is a line of `LONG` words, or if
it has `LONG` words in lines that are not whole in it. Chunks that occur twice, in any texts, are
candidates:

- shortest runs of `MIN_LINES` lines and `MIN_WORDS` words that begin at a boundary. A rolling hash
  over the hashes of its lines gives every run a number; a line is a boundary if the run from it on
  has the smallest number among the runs that lie within `SURE` words in a row, for some such words.
  Boundaries depend on these words only, so they move with their passage, and equal stretches of so
  many words with a run in them have a chunk in common. Smaller repeats may have none, but in texts
  of fewer than `SURE` words every run is a chunk;
- every line of `LONG` words;
- where `SURE` words in a row have no such run of lines in them, runs of `LONG` words chosen by
  winnowing: of every `WINDOW` runs in a row the one with the smallest hash. Equal stretches of
  `SURE` words choose the same one. A run that repeats itself every `WINDOW` words or less is none.

The chunk with the smallest (id, place) stays. Candidates that continue one another are one match.
The bytes of a match and of `AROUND` words on both sides, among which the next boundary would be, are then compared with those that stay, and
what is equal is removed. It is only ever removed for what is equal at a smaller (id, place), so
that one always stays. A Chinese or Japanese character counts as a word.

Only texts with a candidate are shuffled; the others pass through.

Defined results: null and empty texts stay as they are; a text may become empty and its row
stays; rows that repeat an id are never compared at the same place; a row without id stays as it
is. Lines are equal if their bytes are, white space at their ends aside. Columns besides
`doc_id` and `text` are kept untouched but for `n_chars`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.memory import lean
from kartoteka.llm.prefilter import split_by_ids
from kartoteka.llm.spans import Texts, byte_table, mix, slices
from kartoteka.operators.tables import staged_table

MIN_WORDS, MIN_LINES = 8, 2
LONG = 30  # words that are a passage whatever their lines
WINDOW = 21  # runs of words of which one is a chunk
SURE = LONG + WINDOW - 1  # words in a row of which one run, of lines if there is one, is surely a chunk
AROUND = SURE - MIN_WORDS  # words on both sides of a match that are compared, too: so far is the next chunk at most
_LEAST = 2 * MIN_WORDS - 1  # bytes of so many words

_ENDS = byte_table(".,;:!?")
_WIDE_ENDS = [tuple(c.encode()) for c in "。、！？；：，"]
_WHITE = byte_table(" \t\n\r\x0b\x0c")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)


def lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends without white space, ends) of all lines."""
    data = texts.data
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    cut = data == 10
    cut[1:] |= (data[1:] == 32) & _ENDS[data[:-1]]
    if data.max() >= 0xE3:
        for x, y, z in _WIDE_ENDS:
            cut[2:] |= (data[:-2] == x) & (data[1:-1] == y) & (data[2:] == z)
    starts, ends = texts.cut_after(np.flatnonzero(cut) + 1)
    bodies = ends.copy()
    while True:
        white = (bodies > starts) & _WHITE[data[bodies - 1]]
        if not white.any():
            return starts, bodies, ends
        bodies -= white


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a Chinese or Japanese character is one."""
    starts, ends = texts.words
    wide = np.flatnonzero((texts.data >= 0xE3) & (texts.data <= 0xE9))
    if not len(wide):
        return starts, ends
    more = np.concatenate([wide, wide + 3])
    more = more[more < len(texts.data)]
    inside = ends[np.searchsorted(starts, more, "right") - 1] > more
    cut = np.unique(np.concatenate([starts, more[inside]]))
    return cut, np.minimum(np.append(cut[1:], len(texts.data)), ends[np.searchsorted(starts, cut, "right") - 1])


def _runs(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the hashes from `first` to before `last`."""
    n = len(hashes)
    power = np.multiply.accumulate(np.full(n + 1, _BASE, np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power[:-1], dtype=np.uint64)])
    inverse = np.multiply.accumulate(np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))
    return mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))


def _winnowed(hashes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """First words of the runs chosen in the windows that begin at the given words."""
    edge = np.bincount(windows, minlength=len(hashes) + 1) - np.bincount(windows + WINDOW, minlength=len(hashes) + 1)
    wanted = np.cumsum(edge) > 0
    every, place = np.flatnonzero(wanted), np.cumsum(wanted) - 1
    run = _runs(hashes, every, every + LONG)
    for period in range(1, WINDOW + 1):
        again = np.flatnonzero(hashes[every] == hashes[every + period])
        for k in range(1, LONG - period):
            if not len(again):
                break
            again = again[hashes[every[again] + k] == hashes[every[again] + k + period]]
        run[again] = _NONE
    out = []
    for at in range(0, len(windows), 1 << 14):
        part = windows[at:at + (1 << 14)]
        seen = run[place[part][:, None] + np.arange(WINDOW)]
        best = seen.argmin(axis=1)
        out.append((part + best)[seen[np.arange(len(part)), best] < _NONE])
    return np.unique(np.concatenate(out))


def _boundaries(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """Which runs have the smallest hash of all runs in some stretch of `size` words of their text.

    Runs go from word `first` to before `last`, both ascending; their text has the words `low` to
    before `high`. A stretch is told by its first and its last run. As it moves, one run comes in or
    goes out at a time, so there are about two stretches for each run.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, bool)
    begins = np.append(True, low[1:] != low[:-1])
    since = np.where(begins, low, np.append(0, first[:-1]) + 1)  # stretches of which the run is the first begin here
    until = np.minimum(first, np.maximum(low, high - size))
    end = np.searchsorted(low, low, "right") - 1  # the last run of the text
    right = np.minimum(np.searchsorted(last, np.stack([since, until]) + size, "right") - 1, end)
    own = np.flatnonzero((since <= until) & (right[1] >= np.arange(n)))
    nearest = np.maximum(right[0, own], own)
    count = right[1, own] - nearest + 1
    left = np.repeat(own, count)
    stop = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(nearest, count)
    real = (stop == end[left]) | (last[np.minimum(stop + 1, n - 1)] != last[stop])  # runs with one end come in together
    left, stop = left[real], stop[real]
    out = np.zeros(n, bool)
    least, width = np.arange(n), 1  # of the runs from each one on, `width` of them, the one with the smallest hash
    size_of = stop - left + 1
    while len(left):
        now = (size_of >= width) & (size_of < 2 * width)
        a, b = least[left[now]], least[stop[now] - width + 1]
        out[np.where(hashes[b] < hashes[a], b, a)] = True
        if not (size_of >= 2 * width).any():
            break
        further = least[np.minimum(np.arange(n) + width, n - 1)]
        least = np.where(hashes[further] < hashes[least], further, least)
        width *= 2
    return out


def chunks(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, start, size, before, after) of all chunks, in bytes of the own text; the last two are the size of the words on both sides."""
    starts, bodies, _ = lines(texts)
    word_starts, word_ends = tokens(texts)
    n, n_words = len(starts), len(word_starts)
    if not n_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4
    hashes = texts.hashes(starts, bodies)
    words = np.searchsorted(word_starts, np.append(starts, len(texts.data)))
    owner = np.searchsorted(texts.offsets, starts, "right") - 1
    text_words = np.searchsorted(word_starts, texts.offsets)

    stop = np.maximum(np.searchsorted(words, words[:-1] + MIN_WORDS), np.arange(n) + MIN_LINES)
    first = np.flatnonzero(stop <= np.searchsorted(starts, texts.offsets[owner + 1]))
    run = _runs(hashes, first, stop[first])
    edges = (run, words[first], words[stop[first]], text_words[owner[first]], text_words[owner[first] + 1])
    chosen = np.flatnonzero(_boundaries(*edges, SURE) | (edges[4] - edges[3] < SURE))
    alone = np.flatnonzero(np.diff(words) >= LONG)
    line_first, line_last = np.concatenate([first[chosen], alone]), np.concatenate([stop[first[chosen]], alone + 1])
    found = [(np.concatenate([run[chosen], _runs(hashes, alone, alone + 1)]), starts[line_first], bodies[line_last - 1], words[line_first], words[line_last])]

    reach = np.full(n + 1, n_words + SURE)  # the word before which the run from a line on ends
    reach[first] = words[stop[first]]
    word_owner = np.repeat(np.arange(len(texts)), np.diff(text_words))
    at = np.arange(max(0, n_words - SURE + 1))
    # What is at the very edges of a stretch also depends on what is around it, and does not count.
    windows = np.flatnonzero((word_owner[at] == word_owner[at + SURE - 1]) & (reach[np.searchsorted(words[:-1], at, "right")] >= at + SURE))
    if len(windows):
        word_hashes = texts.hashes(word_starts, word_ends)
        picked = _winnowed(word_hashes, windows)
        key = _runs(word_hashes, picked, picked + LONG) ^ _BASE
        found.append((key, word_starts[picked], word_ends[picked + LONG - 1], picked, picked + LONG))

    key, start, end, word, next_word = (np.concatenate(parts) for parts in zip(*found, strict=True))
    owner = np.searchsorted(texts.offsets, start, "right") - 1
    low, high = texts.offsets[owner], texts.offsets[owner + 1]
    since = np.where(word - AROUND > text_words[owner], word_starts[np.maximum(word - AROUND, 0)], low)
    until = np.where(next_word + AROUND < text_words[owner + 1], word_ends[np.minimum(next_word + AROUND, n_words) - 1], high)
    return owner, key, start - low, end - start, start - since, until - end


def chunk_table(docs: DataFrame) -> DataFrame:
    """hash, doc_id, start, size, before and after of every chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                owner, key, *places = chunks(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column(0).take(pa.array(owner + texts.first)), *(pa.array(p, pa.int32()) for p in places)],
                    ["hash", "doc_id", "start", "size", "before", "after"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(lean(run), f"hash long, doc_id {kind}, start int, size int, before int, after int")


def matches(docs: DataFrame) -> DataFrame:
    """Per passage that repeats another: doc_id, shift, whether the other is the same text, and the other's bytes from `since` on."""
    found = staged_table(chunk_table(docs), "chunks")
    repeated = (found.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
                .where("n > 1").select("hash", F.col("first.doc_id").alias("other"), F.col("first.start").alias("other_start")))
    repeated = staged_table(repeated, "repeated_chunks")  # apart from the aggregate, so that Spark can split a chunk with very many rows
    again = found.join(repeated, "hash").where((F.col("doc_id") != F.col("other")) | (F.col("start") != F.col("other_start")))
    joined = staged_table(
        again.groupBy("doc_id", "other", (F.col("start") - F.col("other_start")).alias("shift"))
        .agg(F.min(F.col("start") - F.col("before")).alias("own_since"), F.max(F.col("start") + F.col("size") + F.col("after")).alias("own_until")), "matches")
    others, _ = split_by_ids(docs.select(F.col("doc_id").alias("other"), F.col("text").cast("binary").alias("bytes")), "other", joined.select("other"))
    since = F.greatest(F.col("own_since") - F.col("shift") - 1, F.lit(0))  # and a byte on both sides, which tells whether a word ends there
    until = F.col("own_until") - F.col("shift") + 1
    return (joined.join(others, "other").withColumn("since", since)
            .select("doc_id", "shift", (F.col("doc_id") == F.col("other")).alias("own"), "since", F.substring("bytes", F.col("since") + 1, until - F.col("since")).alias("bytes")))


class _Own:
    """Lines and words of one text, in bytes of it; `line_end` marks white space at the ends of lines."""

    def __init__(self, raw: np.ndarray, line_end: np.ndarray, starts: np.ndarray, bodies: np.ndarray, ends: np.ndarray, word_starts: np.ndarray, word_ends: np.ndarray):
        self.raw, self.line_end, self.starts, self.bodies, self.ends, self.word_starts, self.word_ends = raw, line_end, starts, bodies, ends, word_starts, word_ends
        self.words = np.searchsorted(word_starts, np.append(starts, len(raw)))

    def wide(self, at: int) -> bool:
        """Whether a character that needs no white space after it ends here."""
        return at >= 3 and (0xE3 <= self.raw[at - 3] <= 0xE9 or self.raw[at - 3] == 0xEF)

    def repeated(self, found: Sequence[dict]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Which lines are removed, given the matches, and which spans besides."""
        gone, spans = np.zeros(len(self.starts), bool), []
        for m in found:
            other, low = np.frombuffer(m["bytes"], np.uint8), m["since"] + m["shift"]
            a, b = max(low, 0), min(low + len(other), len(self.raw))
            if b - a < _LEAST:
                continue
            there = other[a - low:b - low]
            bad = a + np.flatnonzero((self.raw[a:b] != there) & ~(self.line_end[a:b] & _WHITE[there]))
            left, right = np.append(a, bad + 1), np.append(bad, b)
            enough = right - left >= _LEAST
            for x, y in zip(left[enough].tolist(), right[enough].tolist(), strict=True):
                closed = y - low >= len(other) or bool(_WHITE[other[y - low]]) or self.wide(y)  # the other's word ends there, too
                opened = x - low < 1 or bool(_WHITE[other[x - low - 1]]) or self.wide(x)
                k, stop = int(np.searchsorted(self.starts, x)), int(np.searchsorted(self.bodies, y, "right"))
                stop -= stop > k and not closed and self.bodies[stop - 1] == y
                n_words = self.words[stop] - self.words[k] if stop > k else 0
                parts = [(x, y)]
                if stop - k >= MIN_LINES and n_words >= MIN_WORDS or n_words >= LONG:
                    gone[k:stop] = True
                    parts = [(x, int(self.starts[k])), (int(self.ends[stop - 1]), y)]
                for since, until in parts:
                    if until - since < 2 * LONG - 1:
                        continue
                    if m["own"]:
                        until = min(until, since + m["shift"])  # no further than the words that it repeats
                    w, last = int(np.searchsorted(self.word_starts, since)), int(np.searchsorted(self.word_ends, until, "right"))
                    w += w < last and not opened and self.word_starts[w] == x
                    last -= last > w and not closed and self.word_ends[last - 1] == y
                    if last - w >= LONG:
                        spans.append((int(self.word_starts[w]), int(self.word_ends[last - 1])))
        return gone, spans


def clean(texts: Texts, found: Sequence[Sequence[dict]]) -> list[tuple[str, int, list[tuple[int, int]]]]:
    """(text that is left, whole lines removed, byte spans removed) of every text of a slice."""
    places, words = lines(texts), tokens(texts)
    size = len(texts.data) + 1
    line_end = np.cumsum(np.bincount(places[1], minlength=size) - np.bincount(places[2], minlength=size)) > 0
    bounds, word_bounds = np.searchsorted(places[0], texts.offsets), np.searchsorted(words[0], texts.offsets)
    out = []
    for i in range(len(texts)):
        base, end = int(texts.offsets[i]), int(texts.offsets[i + 1])
        raw = texts.data[base:end]
        if not found[i]:
            out.append((raw.tobytes().decode(), 0, []))
            continue
        own = _Own(raw, line_end[base:end], *(x[bounds[i]:bounds[i + 1]] - base for x in places), *(x[word_bounds[i]:word_bounds[i + 1]] - base for x in words))
        gone, more = own.repeated(found[i])
        spans: list[tuple[int, int]] = []
        for s, e in sorted([*zip(own.starts[gone].tolist(), own.ends[gone].tolist(), strict=True), *more]):
            if spans and spans[-1][1] >= s:
                spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
            else:
                spans.append((s, e))
        left, at = [], 0
        for s, e in spans:
            left.append(raw[at:s].tobytes())
            at = e
        out.append((b"".join([*left, raw[at:].tobytes()]).decode(), int(gone.sum()), spans))
    return out


def remove_repeated(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, `text` without repeated passages; and `removed_lines`, `removed_spans` (in bytes)."""
    names = docs.columns
    kept = docs.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(names)])
    id_at, text_at = f"kept_{names.index('doc_id')}", f"kept_{names.index('text')}"
    found = staged_table(matches(docs), "repeated")
    touched, untouched = split_by_ids(kept, id_at, found.select("doc_id"))
    listed = found.groupBy("doc_id").agg(F.collect_list(F.struct("shift", "own", "since", "bytes")).alias("matches"))
    joined = touched.join(listed.withColumnRenamed("doc_id", "matched_id"), F.col(id_at) == F.col("matched_id"), "left").drop("matched_id")
    where, last = joined.columns.index(text_at), len(joined.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(where)):
                rows = batch.slice(texts.first, len(texts))
                done = clean(texts, [m.as_py() or [] for m in rows.column(last)])
                null = rows.column(where).is_null().to_pylist()
                cleaned = pa.array([None if n else t for n, (t, *_) in zip(null, done, strict=True)], pa.string())
                columns = [cleaned if i == where else c for i, c in enumerate(rows.columns[:last])]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([n for _, n, _ in done], pa.int64()),
                     pa.array([[{"start": s, "end": e} for s, e in spans] for *_, spans in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    [*rows.schema.names[:last], "removed_lines", "removed_spans"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    spans = "array<struct<start:bigint,end:bigint>>"
    cleaned = joined.mapInArrow(lean(run), f"{fields}, removed_lines long, removed_spans {spans}")
    rest = untouched.withColumns({"removed_lines": F.lit(0).cast("long"), "removed_spans": F.array().cast(spans)})
    out = cleaned.unionByName(rest).select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(names)], "removed_lines", "removed_spans")
    if "n_chars" in names:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size("removed_spans") > 0, changed).otherwise(F.col("n_chars")))
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The columns of `docs` alone, `text` without repeated passages."""
    return remove_repeated(docs).select(*docs.columns)
