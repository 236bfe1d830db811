"""Nearest vectors by largest inner product, over several shifted space-filling curves.

Vectors are projected to a few dimensions in several random ways, shifted, and ordered along a
Hilbert curve each time, so that neighbours along one curve or another are often neighbours in
space. Each ordering is cut into ranges of keys, dealt over the cluster; a query visits its own
range and the next ones on both sides, in every ordering; what it finds is merged and reranked
on the original vectors in double precision.

How many ranges a query visits is learned: for a bounded sample of queries the true neighbours
are found by going through all rows, and the reach is the smallest one that finds `TARGET` of
them. Vectors without structure need a wide reach, which then costs as much as going through all
rows; the recall holds either way. Every row is indexed.

Equal vectors are one entry with the smallest `k + 1` of their ids, so that copies crowd nothing
out; keys end in a hash, so that a dense spot is cut into ranges as well. A query drops what is
under the `k`-th best of a bounded sample of entries, which no result can be.

Defined results: vectors that are null, zero, or with a component that is null or not finite take no
part, nor do rows without id; vectors of unlike length are no neighbours, and each length has a search of its own; a repeated id with an equal
vector counts once; ties go to the smaller id; a query with fewer candidates gets all of them.
Columns besides `vec_id` and `embedding` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.llm.spans import mix
from kartoteka.operators.tables import staged_table

NEIGHBOURS = 20
ORDERINGS, DIMENSIONS, BITS = 8, 4, 10
HASH_BITS = 22
SAMPLE_ROWS = 8_192  # entries that cuts and floors come from, at most
SAMPLE_QUERIES = 96  # queries that the reach is learned from, at most
TARGET = 0.95
RANGES = 64  # of an ordering at least, while they keep enough rows
LEAST_ROWS, MOST_ROWS = 256, 8_192  # of a range, about


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of cell numbers under 2 ** bits.

    From the highest bit down, a set bit mirrors the lower bits of the first coordinate, a clear one exchanges them
    with its own; the Gray code of what results, bit by bit, is the place.
    """
    x = cells.astype(np.uint64).T.copy()
    for level in range(bits - 1, 0, -1):
        bit, lower = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(len(x)):
            mirror = (x[i] & bit) != 0
            swap = np.where(mirror, 0, (x[0] ^ x[i]) & lower).astype(np.uint64)
            x[0] ^= np.where(mirror, lower, swap)
            x[i] ^= swap
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for row in x:
            out = (out << np.uint64(1)) | ((row >> np.uint64(level)) & np.uint64(1))
    return out


@dataclass
class Curves:
    """Projections and shifts, and for each ordering the keys that its ranges start at."""

    axes: np.ndarray  # ordering, component, dimension
    centre: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    cuts: np.ndarray  # ordering, range but the first

    def keys(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Key of each vector in each ordering; `ids` end the keys of vectors in one cell."""
        tail = mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - HASH_BITS)
        out = np.empty((len(self.axes), len(vectors)), np.uint64)
        for t, axes in enumerate(self.axes):
            place = (vectors @ axes - self.centre[t]) / self.scale[t] / 8 + 0.25 + self.shift[t] / 2
            cells = np.clip(place * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
            out[t] = (hilbert_keys(cells, BITS) << np.uint64(HASH_BITS)) | tail
        return out

    def ranges(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Number of the range of each vector in each ordering."""
        return np.stack([np.searchsorted(c, k, "right") for c, k in zip(self.cuts, self.keys(vectors, ids), strict=True)])


def fit_curves(sample: np.ndarray, ids: np.ndarray, ranges: int, seed: int = 1) -> Curves:
    """Random projections, scaled by a sample of vectors, and cuts at its quantiles."""
    rng = np.random.default_rng(seed)
    size = sample.shape[1]
    axes = rng.normal(size=(ORDERINGS, size, min(DIMENSIONS, size)))
    axes /= np.linalg.norm(axes, axis=1, keepdims=True)
    projected = np.einsum("nc,tcd->tnd", sample, axes)
    scale = projected.std(axis=1)
    curves = Curves(axes, projected.mean(axis=1), np.where(scale > 0, scale, 1), rng.random(scale.shape), np.zeros((ORDERINGS, 0), np.uint64))
    keys = np.sort(curves.keys(sample, ids), axis=1)
    curves.cuts = keys[:, [len(ids) * i // ranges for i in range(1, ranges)]]
    return curves


def usable(embedding: Column) -> Column:
    """Whether a vector can take part, its length aside."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: rep (its smallest id), ids (the k + 1 smallest) and vector, in double precision."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, 0.0).otherwise(x)))
    first = Window.partitionBy("vector").orderBy("vec_id")  # each task sends the first few of a vector only
    ranked = rows.withColumn("place", F.rank().over(first)).where(F.col("place") <= k + 1)
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vector")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _best(queries: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest rows of each query and what ties with them, at or over its floor; scores are summed in the order of components."""
    near_q, near_r = [], []
    for start in range(0, len(queries), 256):
        scores = queries[start:start + 256] @ rows.T
        bar = floors[start:start + 256] - 1e-9
        if len(rows) > k:
            bar = np.maximum(bar, np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k] - 1e-9)
        q, r = np.nonzero(scores >= bar[:, None])
        near_q.append(q + start)
        near_r.append(r)
    q, r = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (near_q, near_r))
    exact = (queries[q] * rows[r]).sum(axis=1) if len(q) else np.zeros(0)
    order = np.lexsort((ids[r], -exact, q))  # of ties only the smallest ids can count
    q, r, exact = q[order], r[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return pa.RecordBatch.from_arrays([pa.array(q_ids[q[keep]]), pa.array(ids[r[keep]]), pa.array(exact[keep])], ["query", "near", "score"])


_FOUND = "query long, near long, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, each row once."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "near")
    return (found.groupBy("query", "near").agg(F.max("score").alias("score"))
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))


def _true_neighbours(table: DataFrame, q_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The nearest entries of a few queries, by going through all rows."""
    shared = table.sparkSession.sparkContext.broadcast((q_ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            yield _best(vectors, ids, np.full(len(ids), -np.inf), _matrix(batch.column(1)), batch.column(0).to_numpy(), k)

    return _top(table.select("rep", "vector").mapInArrow(run, _FOUND), k)


def learn_reach(table: DataFrame, queries: DataFrame, curves: Curves, k: int, target: float) -> int:
    """The smallest number of ranges to each side that finds `target` of the sampled queries' true neighbours."""
    rows = queries.select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_QUERIES).collect()
    if not rows:
        return 0
    ids, vectors = np.array([r.rep for r in rows]), np.array([r.vector for r in rows])
    near = _true_neighbours(table, ids, vectors, k + 1).join(table.select(F.col("rep").alias("near"), "vector"), "near").select("query", "near", "vector").collect()
    near = [r for r in near if r.near != r["query"]]
    if not near:
        return 0
    at = dict(zip(ids.tolist(), curves.ranges(vectors, ids).T, strict=True))
    there = curves.ranges(np.array([r.vector for r in near]), np.array([r.near for r in near])).T
    away = np.sort([np.abs(at[r["query"]] - place).min() for r, place in zip(near, there, strict=True)])
    return int(away[min(len(away) - 1, int(np.ceil(target * len(away))) - 1)])


def _dealt(table: DataFrame, curves: Curves, reach: int, floors_from: np.ndarray | None, k: int) -> DataFrame:
    """A row for each ordering and range that an entry lies in, or that a query (then with its floor) visits."""
    shared = table.sparkSession.sparkContext.broadcast((curves, floors_from))
    last = curves.cuts.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sample = shared.value
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.slice(start, 2048)
                vectors, ids = _matrix(part.column(1)), part.column(0).to_numpy()
                if not len(ids):
                    continue
                floors = np.full(len(ids), -np.inf)
                if sample is not None and len(sample) > k:
                    floors = np.partition(vectors @ sample.T, len(sample) - k, axis=1)[:, len(sample) - k]
                for ordering, middle in enumerate(own.ranges(vectors, ids)):
                    for step in range(-reach, reach + 1):
                        to = middle + step
                        inside = pa.array((to >= 0) & (to <= last))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(ids), ordering, np.int32)).filter(inside), pa.array(to.astype(np.int32)).filter(inside),
                             part.column(0).filter(inside), part.column(1).filter(inside), pa.array(floors).filter(inside)],
                            ["ordering", "part", "rep", "vector", "floor"])

    return table.select("rep", "vector").mapInArrow(run, "ordering int, part int, rep long, vector array<double>, floor double")


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the nearest found of every query row; each length of vector is searched by itself."""
    lengths = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.size("embedding").alias("size")).distinct().collect()
    found = [_nearest(vectors.where(F.size("embedding") == size), is_query, k, target) for size in sorted(r["size"] for r in lengths)]
    return reduce(DataFrame.unionByName, found) if found else _nearest(vectors, is_query, k, target)


def _nearest(vectors: DataFrame, is_query: Column, k: int, target: float) -> DataFrame:
    table = staged_table(entries(vectors.select(F.col("vec_id").cast("long"), "embedding"), k), "entries")
    asked = (vectors.where(is_query & F.col("vec_id").isNotNull() & usable(F.col("embedding")))
             .select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).distinct())
    asked = asked.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, 0.0).otherwise(x)))
    asked = staged_table(asked.join(table.select("vector", "rep"), "vector").select("query_id", "rep"), "asked")
    queries = staged_table(table.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vector"), "queries")

    count = table.count()
    ranges = max(1, min(RANGES, count // LEAST_ROWS), count // MOST_ROWS)
    sample = table.select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).collect()
    if not sample:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("rep").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    picked, picked_ids = np.array([r.vector for r in sample]), np.array([r.rep for r in sample])
    curves = fit_curves(picked, picked_ids, ranges)
    reach = learn_reach(table, queries, curves, k, target) if ranges > 1 else 0

    rows = _dealt(table, curves, 0, None, k + 1).groupBy("ordering", "part")
    visits = _dealt(queries, curves, reach, picked, k + 1).groupBy("ordering", "part")

    def meet(there: pa.Table, visiting: pa.Table) -> pa.Table:
        if not there.num_rows or not visiting.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.Table.from_batches([_best(_matrix(visiting["vector"]), visiting["rep"].to_numpy(), visiting["floor"].to_numpy(),
                                            _matrix(there["vector"]), there["rep"].to_numpy(), k + 1)])

    found = _top(rows.cogroup(visits).applyInArrow(meet, _FOUND), k + 1)
    # From distinct vectors back to rows: only the first ids of a vector can be among the nearest.
    of_query = found.join(table.select(F.col("rep").alias("near"), "ids"), "near").select("query", "score", F.explode("ids").alias("vec_id"))
    paired = asked.join(of_query, asked["rep"] == of_query["query"]).where(F.col("query_id") != F.col("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (paired.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
