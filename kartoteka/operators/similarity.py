"""Cosine top-k over a vector table: exact, and approximate by cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartoteka.functions.vectors import norm
from kartoteka.operators.joins import measured
from kartoteka.operators.probes import scan_probes, to_arrow_schema
from kartoteka.operators.tables import staged_table
from kartoteka.operators.topk import merge_top, top_per_key

# Similarities are compared at this many digits, so that equal vectors tie
# whichever batch they are read in, and ties go to the lower item.
DIGITS = 9

# Scores held in memory at a time.
SCORES_AT_ONCE = 1_000_000


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lengths(column: pa.Array) -> np.ndarray:
    """Number of components of each vector, 0 for a vector with a missing one."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if column.flatten().null_count:
        holes = np.unique(pc.list_parent_indices(column).to_numpy()[column.flatten().is_null().to_numpy(zero_copy_only=False)])
        sizes[holes] = 0
    return sizes


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; a row without length becomes NaN, which is similar to nothing."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _sortable(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


class NearestItems:
    """The k most similar items per query, each with its best chunk."""

    def __init__(self, probes: pa.Table, k: int, out: pa.Schema):
        self.k, self.out = k, out
        self.queries = probes["__query"].combine_chunks()
        # Vectors of one length are only ever compared with each other.
        lengths = _lengths(probes["__vector"].combine_chunks()) if len(probes) else np.zeros(0, np.int64)
        self.by_length = {}
        for length in np.unique(lengths[lengths > 0]).tolist():
            which = np.flatnonzero(lengths == length)
            self.by_length[length] = which, _unit(_matrix(probes["__vector"].combine_chunks().take(pa.array(which))))
        self.allowed = self._cells(probes) if "__cells" in probes.column_names else None
        self.kept: list[tuple[np.ndarray, ...] | None] = [None] * len(probes)
        self.floor = np.full(len(probes), -np.inf)

    @staticmethod
    def _cells(probes: pa.Table) -> np.ndarray:
        listed = probes["__cells"].to_pylist()
        allowed = np.zeros((len(listed), 1 + max((max(c) for c in listed if c), default=0)), dtype=bool)
        for i, cells in enumerate(listed):
            allowed[i, cells] = True
        return allowed

    def add(self, batch: pa.RecordBatch) -> None:
        lengths = _lengths(batch["__vector"])
        for length, (which, vectors) in self.by_length.items():
            fitting = batch if (lengths == length).all() else batch.filter(pa.array(lengths == length))
            step = max(1, SCORES_AT_ONCE // len(vectors))
            for start in range(0, len(fitting), step):
                self._add(fitting.slice(start, step), which, vectors)

    def _add(self, batch: pa.RecordBatch, which: np.ndarray, vectors: np.ndarray) -> None:
        items, chunks = _sortable(batch["__item"]), batch["__chunk"].to_numpy(zero_copy_only=False)
        found = np.round(vectors @ _unit(_matrix(batch["__vector"])).T, DIGITS)
        wanted = found >= self.floor[which, None]
        if self.allowed is not None:
            cells = batch["__cell"].to_numpy(zero_copy_only=False)
            known = cells < self.allowed.shape[1]
            wanted &= self.allowed[which][:, np.where(known, cells, 0)] & known
        for row in np.flatnonzero(wanted.any(axis=1)):
            q, at = which[row], wanted[row]
            fresh = (found[row, at], items[at], chunks[at])
            held = self.kept[q]
            self.kept[q] = self._cut(*fresh if held is None else map(np.concatenate, zip(held, fresh)))
            if len(self.kept[q][0]) == self.k:
                self.floor[q] = self.kept[q][0][-1]

    def _cut(self, sims: np.ndarray, items: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, ...]:
        take = 8 * self.k
        while True:
            everything = take >= len(sims)
            near = np.arange(len(sims)) if everything else np.flatnonzero(sims >= np.partition(sims, -take)[-take])
            near = near[np.lexsort((chunks[near], items[near], -sims[near]))]
            best = np.sort(np.unique(items[near], return_index=True)[1])[: self.k]
            if everything or len(best) == self.k:
                return sims[near[best]], items[near[best]], chunks[near[best]]
            take *= 8

    def result(self) -> pa.RecordBatch:
        held = [(q, *kept) for q, kept in enumerate(self.kept) if kept is not None]
        at = np.repeat([h[0] for h in held], [len(h[1]) for h in held]).astype(np.int64)
        sims, items, chunks = (np.concatenate([h[n] for h in held]).tolist() if held else [] for n in (1, 2, 3))
        queries = self.queries.take(pa.array(at)).cast(self.out.field(0).type)
        rest = [pa.array(values, f.type) for values, f in zip((items, chunks, sims), list(self.out)[1:])]
        return pa.RecordBatch.from_arrays([queries, *rest], schema=self.out)


def _scored(corpus: DataFrame, queries: DataFrame, k: int, item: str, vector: str, chunk: str | None, query: str,
            query_vector: str, cell: str | None, cells: str | None, limits: dict) -> DataFrame:
    chunk_col = F.col(chunk).cast("int") if chunk else F.lit(0)
    data = corpus.where(F.col(vector).isNotNull() & F.col(item).isNotNull()).select(
        F.col(item).alias("__item"), chunk_col.alias("__chunk"), F.col(vector).alias("__vector"),
        *([F.col(cell).alias("__cell")] if cell else []))
    probes = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query).alias("__query"), F.col(query_vector).alias("__vector"),
        *([F.col(cells).alias("__cells")] if cells else []))
    schema = T.StructType([
        T.StructField(query, queries.schema[query].dataType),
        T.StructField(item, corpus.schema[item].dataType),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("similarity", T.DoubleType()),
    ])
    out = to_arrow_schema(schema)
    partial = scan_probes(
        data, probes, lambda held: NearestItems(held, k, out), schema,
        probe_key=["__query"], width=F.size("__vector") * 8, **limits)
    nearest_first = [F.col("similarity").desc(), F.col("chunk")]
    ranked = merge_top(partial, [query], [F.col("similarity").desc(), F.col(item)], k, salt_on=[item], rank_as="rank",
                       first_of=nearest_first)
    return ranked.select(query, "rank", item, "chunk", "similarity")


def cosine_topk(
    corpus: DataFrame, queries: DataFrame, k: int, *, item: str, vector: str = "embedding", chunk: str | None = None,
    query: str = "query_id", query_vector: str = "embedding", **limits: int,
) -> DataFrame:
    """(query, rank, item, chunk, similarity) of the k most similar items per query.

    Vectors without length are left out, and a query only meets vectors with as many components
    as its own: a table may hold those of several models. Of an item's chunks only the best counts.
    `limits` are those of `scan_probes`.
    """
    return _scored(corpus, queries, k, item, vector, chunk, query, query_vector, None, None, limits)


def cosine_topk_among(
    corpus: DataFrame, queries: DataFrame, k: int, allowed: DataFrame, *, item: str, query: str = "query_id",
    widen: int = 10, **how: object,
) -> DataFrame:
    """`cosine_topk` over the items that `allowed`, a frame with the item column, has.

    Sorting out the vectors first would shuffle all of them. Instead a longer list is
    found by a scan and sorted out afterwards. A query whose list was full and yet left
    it with fewer than k items is asked again, among the allowed vectors only. The result
    is a written table.
    """
    longer = staged_table(cosine_topk(corpus, queries, k * widen, item=item, query=query, **how), "longer")
    valid = allowed.select(item).join(measured(longer.select(item).distinct()), item, "left_semi").distinct()
    kept = longer.drop("rank").join(valid, item, "left_semi")
    order = [F.col("similarity").desc(), F.col(item)]
    top = staged_table(top_per_key(kept, [query], order, k, "rank").select(longer.columns), "kept")

    full = longer.groupBy(query).agg(F.count("*").alias("__found")).where(F.col("__found") == k * widen)
    enough = top.groupBy(query).agg(F.count("*").alias("__kept")).where(F.col("__kept") == k)
    short = full.join(enough, query, "left_anti").select(query)
    if short.isEmpty():
        return top
    again = cosine_topk(
        corpus.join(allowed.select(item), item, "left_semi"), queries.join(short, query, "left_semi"), k,
        item=item, query=query, **how)
    return staged_table(top.join(short, query, "left_anti").unionByName(again), "nearest")


@dataclass(frozen=True)
class Cells:
    """Centres that divide a vector table; a bounded array of `lists` x dimension."""

    centres: np.ndarray

    @classmethod
    def fit(cls, training: DataFrame, vector: str = "embedding", lists: int = 100, seed: int = 7,
            iterations: int = 10) -> Cells:
        """Cluster the directions of the training vectors that have as many components as most do."""
        sizes = training.where(norm(vector) > 0).groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"))
        size = sizes.orderBy(F.desc("n"), "size").first()["size"]
        vectors = training.where((norm(vector) > 0) & (F.size(vector) == size)).select(
            array_to_vector(F.col(vector).cast("array<double>")).alias("vector"))
        directions = Normalizer(inputCol="vector", outputCol="direction").transform(vectors)
        model = KMeans(k=lists, seed=seed, maxIter=iterations, featuresCol="direction").fit(directions)
        return cls(_unit(np.array(model.clusterCenters())))

    def nearest(self, df: DataFrame, vector: str, out: str, n: int = 1) -> DataFrame:
        """Add the numbers of the n nearest cells, the nearest first; NULL for a vector of another length."""
        centres = self.centres

        @F.arrow_udf("array<int>")
        def nearest_cells(vectors: pa.Array) -> pa.Array:
            fitting = _lengths(vectors) == centres.shape[1]
            rows = _matrix(vectors.filter(pa.array(fitting)))
            near = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :n] if len(rows) else np.zeros((0, n), np.int64)
            offsets = np.concatenate([[0], np.cumsum(fitting)]) * near.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(near.ravel(), pa.int32()), mask=pa.array(~fitting))

        return df.withColumn(out, nearest_cells.asNondeterministic()(F.col(vector)))

    def assign(self, corpus: DataFrame, vector: str = "embedding", out: str = "cell") -> DataFrame:
        """Add each vector's cell. Write the result partitioned by it, and searches read few folders."""
        return self.nearest(corpus, vector, "__near").withColumn(out, F.col("__near")[0]).drop("__near")


def ann_topk(
    celled: DataFrame, queries: DataFrame, cells: Cells, k: int, *, probe: int = 10, item: str,
    vector: str = "embedding", chunk: str | None = None, query: str = "query_id", query_vector: str = "embedding",
    cell: str = "cell", **limits: int,
) -> DataFrame:
    """Like `cosine_topk`, but each query looks only into its `probe` nearest cells."""
    asked = cells.nearest(queries.where(F.col(query_vector).isNotNull()), query_vector, "__probe", min(probe, len(cells.centres)))
    visited = asked.select(F.explode("__probe").alias(cell)).distinct()
    # at most one row per centre, so the side is small whatever the data
    near = celled.join(F.broadcast(visited), cell, "left_semi")
    return _scored(near, asked, k, item, vector, chunk, query, query_vector, cell, "__probe", limits)
