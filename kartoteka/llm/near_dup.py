"""Near-duplicate documents: HyperMinHash registers, banded, estimated, then confirmed on full sets.

A document is the set of its five-word shingles. Documents with equal sets are one class from
the start, so that copies cost one row each. Each class has 128 registers; a register keeps the
smallest hash under its own permutation as a count of leading zeros and ten mantissa bits, 16
bits instead of 64. Four registers make a band of 64 bits, which is its own key: two sets with a
similarity of 0.75 share none of 32 bands with a probability of 5e-6. Equal registers of unlike
sets are expected at a rate that follows from their sizes; the estimate is corrected for it.

Candidates are not all pairs of a bucket. First every member is compared with the bucket's
smallest member and with one chosen by hash; what is confirmed is united into components. Then
only members of buckets that still hold several components are compared, and only across
components and against the members outside the bucket's largest one, so that a bucket of
thousands of near copies, once united, makes no more pairs. Members of a large bucket meet in
blocks, with their full sets, and only links come out. No candidate that could still change a
component is left out. Links are confirmed on the full sets of the whole texts.

Defined results: null and empty texts have no shingles and are linked with nothing; fewer than
five words are one shingle; rows that repeat an id count as one document; a row without id is
linked with nothing, its `component_id` is null and it is kept. Columns besides `doc_id` and
`text` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.components import components
from kartoteka.llm.memory import lean
from kartoteka.llm.prefilter import split_by_ids
from kartoteka.llm.spans import Texts, mix, slices, whole_hash
from kartoteka.operators.tables import staged_table

WORDS = 5
PERCENT = 75
REGISTERS, BAND = 128, 4
MANTISSA = 10
SMALL, BLOCK = 24, 2048  # members of a bucket that is joined with itself; of a block of a larger one
MARGIN = 0.25  # below the threshold an estimate may be: over six standard errors

_MULTIPLIERS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: Texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    low = texts.lowered()
    first, hashes = low.windows(WORDS)
    owner = low.word_owner[first] if len(first) else first
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    words = low.word_bounds.tolist()
    out = []
    for i in range(len(texts)):
        if bounds[i] < bounds[i + 1]:
            out.append(np.unique(hashes[bounds[i]:bounds[i + 1]]))
        elif words[i] < words[i + 1]:
            out.append(np.array([whole_hash(low.word_hashes[words[i]:words[i + 1]])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the first one, in 16 bits."""
    exact = least >> np.uint64(11)  # as many bits as a float holds
    length = np.frexp(exact.astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(53) - length
    rest = np.where(zeros < 53, (least << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA), 0)
    return ((zeros << np.uint64(MANTISSA)) | rest).astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets, a row each."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), REGISTERS), np.uint16)
    for k, multiplier in enumerate(_MULTIPLIERS):
        out[:, k] = compress(np.minimum.reduceat(flat * multiplier, starts))
    return out


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often registers of unrelated sets of n and m elements are equal: in the same octave, with the same mantissa."""
    out = np.zeros(len(n))
    for zeros in range(54):
        low, high = 2.0 ** -(zeros + 1), 2.0 ** -zeros
        out += (np.exp(-n * low) - np.exp(-n * high)) * (np.exp(-m * low) - np.exp(-m * high))
    return out / (1 << MANTISSA)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two sums that tell sets apart, and the registers as 64-bit bands; no bands without shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                sets = shingle_sets(texts)
                filled = [s for s in sets if len(s)]
                bands = registers(filled).view(np.int64) if filled else np.zeros((0, REGISTERS // BAND), np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes > 0)]) * (REGISTERS // BAND)
                sums = [[int(mix(s ^ np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for seed in (0, 0x5851F42D4C957F2D)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)), pa.array(sizes), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(bands.ravel(), pa.int64()))],
                    ["doc_id", "n_shingles", "sum_a", "sum_b", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, sum_a long, sum_b long, bands array<long>")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and whose corrected estimate is near enough to the threshold."""
    side = classes.select("rep", "n_shingles", "bands")
    joined = (pairs.select("a", "b").join(side.toDF("a", "n_a", "bands_a"), "a").join(side.toDF("b", "n_b", "bands_b"), "b")
              .where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy().astype(float), batch.column(4).to_numpy().astype(float)
            left, right = (batch.column(c).flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS) for c in (3, 5))
            chance = collision_rate(n, m)
            estimate = ((left == right).mean(axis=1) - chance) / (1 - chance)
            near = pa.array(estimate >= PERCENT / 100 - MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    kind = classes.schema["rep"].dataType.simpleString()
    return joined.select("a", "b", "n_a", "bands_a", "n_b", "bands_b").mapInArrow(lean(run), f"a {kind}, b {kind}")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are linked, by the full sets of their whole texts; `texts` has rep and text."""
    joined = (pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b"))

    def sets(column: pa.Array) -> list[np.ndarray]:
        distinct = column.dictionary_encode()
        found = [s for part in slices(distinct.dictionary) for s in shingle_sets(part)]
        return [found[i] for i in distinct.indices.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                linked = []
                for x, y in zip(sets(part.column(2)), sets(part.column(3)), strict=True):
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")  # merges two sorted runs
                    common = int((both[1:] == both[:-1]).sum())
                    linked.append(100 * common >= PERCENT * (len(x) + len(y) - common))
                keep = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(lean(run), f"a {kind}, b {kind}").distinct()


def _star_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's smallest member and with one chosen by hash."""
    return (members.select("rep", F.explode(F.array("low", "chosen")).alias("centre")).where("rep <> centre")
            .select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct())


def _shingles(texts: DataFrame) -> DataFrame:
    """rep and the sorted distinct shingle hashes of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                sets = shingle_sets(part)
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part)),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], ["rep", "shingles"])

    kind = texts.schema["rep"].dataType.simpleString()
    found = texts.select("rep", "text").mapInArrow(lean(run), f"rep {kind}, shingles array<long>")
    return found.where(F.size("shingles") > 0)  # a repeated id may have an empty text too


def _common(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of `left`, how many shingles it has in common with every row of `right`."""
    x, y = (t["shingles"].combine_chunks() for t in (left, right))
    known, place = np.unique(y.flatten().to_numpy(), return_inverse=True)
    bounds = y.offsets.to_numpy()[:-1] - y.offsets[0].as_py()
    for i in range(len(x)):
        own = x[i].values.to_numpy()
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        marked = np.zeros(len(known), np.int32)
        marked[at[known[at] == own]] = 1
        yield i, np.add.reduceat(marked[place], bounds)


def _linked_in_blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across components within large buckets: members meet in blocks, with their full sets, and only links come out.

    A bucket is a grid of blocks of about `BLOCK` members a side, so that no task holds a bucket.
    """
    sets = _shingles(texts.join(members.select("rep").distinct(), "rep", "left_semi"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = members.join(sets, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    others = F.explode(F.sequence(F.lit(0), blocks - 1))
    x = own.where("component <> largest").withColumn("y_block", others).withColumnRenamed("own", "x_block")
    y = own.withColumn("x_block", others).withColumnRenamed("own", "y_block")
    grid = ["band", "key", "x_block", "y_block"]
    columns = [*grid, "rep", "component", "largest", "n_shingles", "shingles"]
    kind = members.schema["rep"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        if left.num_rows and right.num_rows:
            (rep_x, of_x, n_x), (rep_y, of_y, n_y) = ([t[c].to_numpy() for c in ("rep", "component", "n_shingles")] for t in (left, right))
            in_largest = of_y == right["largest"].to_numpy()
            for i, common in _common(left, right):
                linked = 100 * common >= PERCENT * (n_x[i] + n_y - common)
                j = np.flatnonzero(linked & (of_y != of_x[i]) & (in_largest | (rep_x[i] < rep_y)))
                found_a.append(np.minimum(rep_x[i], rep_y[j]))
                found_b.append(np.maximum(rep_x[i], rep_y[j]))
        return pa.table({c: pa.array(np.concatenate(f) if f else [], id_type) for c, f in (("a", found_a), ("b", found_b))})

    y = y.select(*[F.col(c).alias(c) for c in columns])  # columns of its own, as both sides come from one table
    return x.select(*columns).groupBy(*grid).cogroup(y.groupBy(*grid)).applyInArrow(compare, f"a {kind}, b {kind}")


def _crossing_links(members: DataFrame, component: DataFrame, classes: DataFrame, texts: DataFrame, tried: DataFrame) -> DataFrame:
    """Links between members of a bucket in different components, one of them outside the bucket's largest component.

    Small buckets are joined with themselves, which makes at most `SMALL` rows of each member.
    """
    named = (members.select("band", "key", "rep", "n_shingles").join(component.select(F.col("vertex").alias("rep"), "component"), "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")))
    counted = named.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    open_ = (counted.groupBy("band", "key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("largest"))
             .where("parts > 1").select("band", "key", "largest", "n"))
    left = staged_table(named.join(open_, ["band", "key"]), "open_buckets")

    small = left.where(F.col("n") <= SMALL)
    x = small.where("component <> largest").select("band", "key", F.col("rep").alias("x"), F.col("component").alias("of_x"), F.col("n_shingles").alias("n_x"))
    y = small.select("band", "key", F.col("rep").alias("y"), F.col("component").alias("of_y"), "largest", F.col("n_shingles").alias("n_y"))
    pairs = (x.join(y, ["band", "key"])
             .where((F.col("of_x") != F.col("of_y")) & ((F.col("of_y") == F.col("largest")) | (F.col("x") < F.col("y")))
                    & (100 * F.least("n_x", "n_y") >= PERCENT * F.greatest("n_x", "n_y"))))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    in_small = confirm(staged_table(likely(pairs, classes), "crossing_pairs"), texts)
    return in_small.unionByName(_linked_in_blocks(left.where(F.col("n") > SMALL), texts)).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept, for every row."""
    rows = staged_table(signatures(docs), "signatures")
    filled = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    same = ["n_shingles", "sum_a", "sum_b"]
    classes = staged_table(
        filled.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "classes")

    banded = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = (banded.groupBy("band", "key")
               .agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.min(F.struct(F.xxhash64("rep", "band"), "rep")).alias("by_hash"))
               .where("n > 1").select("band", "key", "low", F.col("by_hash.rep").alias("chosen")))
    members = staged_table(banded.join(buckets, ["band", "key"]), "buckets")

    wanted = members.select("rep").distinct()
    possible, _ = split_by_ids(docs.select(F.col("doc_id").alias("rep"), "text"), "rep", wanted)
    texts = staged_table(possible.join(wanted, "rep", "left_semi"), "candidate_texts")
    tried = staged_table(likely(_star_pairs(members), classes), "star_pairs")
    links = staged_table(confirm(tried, texts), "star_links")
    found = components(links)
    more = staged_table(_crossing_links(members, found, classes, texts, tried), "crossing_links")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    named = (classes.join(found.select(F.col("vertex").alias("rep"), "component"), "rep", "left")
             .where("copies > 1 or component is not null").select(*same, F.coalesce("component", "rep").alias("component")))
    out = filled.drop("bands").join(named, same, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    alone = rows.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all columns, without those that another document of their group stands for."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    gone = staged_table(gone, "gone")
    possible, sure = split_by_ids(docs, "doc_id", gone)
    return possible.join(gone, "doc_id", "left_anti").select(*docs.columns).unionByName(sure)
