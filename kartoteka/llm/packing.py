"""Packing documents into sequences of equal length, as a cutting-stock problem.

A document's ids are cut into full sequences, a half if there is room for it, and a rest: rests
are shorter than half a sequence, so that no length is left without a partner. Only the number of rests of each
length matters for a good packing, so that the driver sees a histogram of at most `size` rows,
however many documents there are. A linear program over patterns (how many rests of each length
fill a sequence) is solved by column generation: the dual price of each length comes from the
current basis, and a knapsack by dynamic programming finds the pattern that is worth most.
Patterns are used as often as the solution says, rounded down; what is left over is less than
a few rests of each length and goes by best fit. Rests are ranked within their length and dealt
to the places that the patterns have for it.

Lengths are counted in units of `UNIT` ids, rounded up: the linear program then has few enough
rows to end near its optimum, at the price of less than a unit of padding for each rest.

Ranks come from counts by length and hash bucket, so that no length has to be sorted in one
task. A full sequence needs no rank: it is a sequence by itself.

Defined results: null and empty texts have only the closing id; repeated rows are packed each;
an empty table has no pieces. Columns besides `doc_id` and `text` are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.llm.byte_bpe import Encoded, Encoder, Vocabulary, map_encoded
from kartoteka.llm.spans import Texts
from kartoteka.operators.tables import staged_table

SIZE = 1024
CLOSING = 0  # id after each document
UNIT = 4  # lengths that differ by less share a row of the linear program
GAP = 0.0005  # the linear program ends this near to its lower bound
MAX_ROUNDS = 3_500
RANK_ROWS = 50_000  # rests ranked together, about

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def pieces(docs: DataFrame, vocabulary: Vocabulary, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each full sequence, half and rest."""
    half = size // 2

    def cuts(encoded: Encoded) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        tokens = np.diff(encoded.bounds) + 1
        full, rest = tokens // size, tokens % size
        has_half = rest >= half
        parts = full + has_half + (rest > half * has_half)
        owner = np.repeat(np.arange(len(tokens)), parts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        after = place > full[owner]
        start = np.where(after, full[owner] * size + half, place * size)
        length = np.where(place < full[owner], size, np.where(has_half[owner] & ~after, half, tokens[owner] - start))
        return owner, start, length, tokens[owner]

    def make(own: Encoder, texts: Texts, encoded: Encoded) -> list[pa.Array]:
        owner, start, length, tokens = cuts(encoded)
        ids = np.insert(encoded.ids, encoded.bounds[1:], CLOSING).astype("<u4")
        at = encoded.bounds[owner] + owner + start
        raw = memoryview(ids.tobytes())
        sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
        return [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64()), pa.array(tokens, pa.int64())]

    return map_encoded(docs, vocabulary, make, "start long, length long, ids_crc32 long, doc_tokens long", rows=lambda e: cuts(e)[0])


def best_pattern(prices: np.ndarray, lengths: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """The most valuable multiset of lengths that fits, by unbounded knapsack; places of lengths and how often."""
    value, choice = np.zeros(size + 1), np.full(size + 1, -1)
    shortest = int(lengths[0])
    upto = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(shortest, size + 1):
        n = upto[c]
        worth = value[c - lengths[:n]] + prices[:n]
        k = int(worth.argmax())
        value[c], choice[c] = worth[k], k
        if value[c - 1] >= value[c]:
            value[c], choice[c] = value[c - 1], -1
    out: Counter[int] = Counter()
    c = size
    while c >= shortest:
        if choice[c] < 0:
            c -= 1
        else:
            out[int(choice[c])] += 1
            c -= int(lengths[choice[c]])
    return float(value[size]), dict(out)


def column_generation(histogram: Mapping[int, int], size: int, gap: float = GAP, rounds: int = MAX_ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Patterns (how often each length, lengths ascending) of a basis near the optimum, and how often each is used."""
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[x] for x in lengths.tolist()], float)
    n = len(lengths)
    if not n:
        return []
    columns = np.diag((size // lengths).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    used = demand / np.diag(columns)
    floor = (lengths * demand).sum() / size
    for _ in range(rounds):
        total = used.sum()
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(prices, lengths, size)
        floor = max(floor, total / max(worth, 1))
        if worth <= 1 + 1e-9 or total <= floor * (1 + gap):
            break
        entering = np.zeros(n)
        entering[list(pattern)] = list(pattern.values())
        direction = (inverse * entering).sum(axis=1)  # small, and quicker than waking threads
        up = direction > 1e-7
        if not up.any():
            break
        ratio = np.full(n, np.inf)
        ratio[up] = used[up] / direction[up]
        leaving = int(ratio.argmin())
        columns[:, leaving] = entering
        row = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, row)
        inverse[leaving] = row
        used = np.maximum((inverse * demand).sum(axis=1), 0)
    return [(columns[:, j], float(used[j])) for j in range(n)]


def best_fit(histogram: Mapping[int, int], size: int) -> Counter[Pattern]:
    """Sequences for a small number of rests: the longest first, each where the least room is left."""
    open_: list[tuple[int, int]] = []  # (room, sequence)
    filled: list[Counter[int]] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = bisect_left(open_, (length, -1))
            if at < len(open_):
                room, k = open_.pop(at)
            else:
                room, k = size, len(filled)
                filled.append(Counter())
            filled[k][length] += 1
            if room > length:
                insort(open_, (room - length, k))
    return Counter(tuple(sorted(f.items(), reverse=True)) for f in filled)


def plan(histogram: Mapping[int, int], size: int) -> Counter[Pattern]:
    """Patterns and how often to use each, so that every rest has exactly one place."""
    lengths = sorted(histogram)
    left = Counter(histogram)
    out: Counter[Pattern] = Counter()
    solution = [(tuple((lengths[i], int(counts[i])) for i in np.flatnonzero(counts)[::-1]), used)
                for counts, used in column_generation(histogram, size)]
    whole = [(pattern, int(used + 1e-6)) for pattern, used in solution]
    # Once more each where enough is left, the largest remainders and the fullest sequences first.
    again = [(pattern, 1) for pattern, used in sorted(solution, key=lambda s: (int(s[1]) - s[1], -sum(x * n for x, n in s[0])))]
    for pattern, most in whole + again:
        times = min([most, *(left[x] // n for x, n in pattern)])
        if times > 0:
            out[pattern] += times
            for x, n in pattern:
                left[x] -= n * times
    out.update(best_fit({x: n for x, n in left.items() if n}, size))
    return out


def places(patterns: Mapping[Pattern, int]) -> pd.DataFrame:
    """For each length, which ranks go to which pattern: from (the first rank), times, sequence and slot (the first ones)."""
    rows, taken, sequence = [], Counter(), 0
    for pattern, times in sorted(patterns.items(), reverse=True):
        slot = 0
        for length, n in pattern:
            rows.append((length, taken[length], times, sequence, slot))
            taken[length] += n * times
            slot += n
        sequence += times
    return pd.DataFrame(sorted(rows), columns=["length", "from", "times", "sequence", "slot"]).astype("int64")


def pack(docs: DataFrame, vocabulary: Vocabulary, size: int = SIZE, unit: int = UNIT) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if size % unit:
        raise ValueError("a sequence is a whole number of units")
    cut = staged_table(pieces(docs, vocabulary, size), "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rests = cut.where(F.col("length") < size).withColumn("units", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r.units: r.n for r in rests.groupBy("units").agg(F.count("*").alias("n")).collect()}
    buckets = max(16, -(-max(histogram.values(), default=0) // RANK_ROWS))
    where = places(plan(histogram, size // unit))
    sequences = int((where["sequence"] + where["times"]).max()) if len(where) else 0
    keys = (where["length"] * (1 << 40) + where["from"]).to_numpy()
    times, first, slot, start = (where[c].to_numpy() for c in ("times", "sequence", "slot", "from"))

    bucketed = rests.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = bucketed.groupBy("units", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("units").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("units", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("units", "bucket").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    ranked = (bucketed.withColumn("place", F.row_number().over(within)).join(bases, ["units", "bucket"])
              .select(*names, F.col("units").cast("long"), (F.col("base") + F.col("place") - 1).alias("place")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            k = np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1
            since = rank - start[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first[k] + since % times[k]), pa.array(slot[k] + since // times[k])],
                [*names, "sequence_id", "slot"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = ranked.mapInArrow(deal, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.select(*names, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))
    full = cut.where(F.col("length") == size).select(*names, (F.lit(sequences) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return offsets.unionByName(full)
