"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are letter runs in lower case and their first four to six letters. All terms of a bounded
sample of labelled texts are used, those of clean texts too; document frequencies are counted over
all documents. A term weighs its inverse document frequency times its relevance frequency,
log2(2 + toxic / clean examples that have it), which is one at least: no term is left out.

The examples are an inverted index by blocks, with the largest weight of each term in a block. A block
holds examples of like words (of one language, say), and texts of like words meet it together: the terms
that many of them share with many of its examples are a dense product, the others are looked up. Texts
whose bound, the sum of these largest weights, does not reach their k-th best cosine pass a block by. All
sums are in double precision, so that the nearest examples are exact. Their labels vote by similarity,
together with the rate of all examples; votes are calibrated on the examples, each left out once.

Texts are read twice, for the document frequencies and for the scores; nothing of them is written.

Defined results: null, empty and term-less texts get the calibrated rate of such examples, texts
without a term of the sample that of all examples; equal texts get equal scores; ties among
examples go to the smaller id; without labelled rows every score is 0. Labels are 0 or 1, others
teach nothing; an id with both counts as toxic. Columns besides `doc_id`, `text` (and `toxic` of
the labels) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.llm.letters import HashTable, LetterRuns, tables
from kartoteka.llm.memory import lean, release
from kartoteka.llm.spans import Texts, slices
from kartoteka.operators.tables import staged_table

TRAINING_TEXTS = 8_000  # labelled examples, at most
PREFIXES = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 4000  # examples in a block
KINDS = 8  # kinds that examples and texts are told apart by
KIND_EXAMPLES = 2000  # examples that kinds are learned from, at most
COMMON = 16  # kinds are told apart by the terms that more than one in so many examples has
PORTION = 1024  # texts that are put together by kind, about
PORTION_TERMS = 1 << 20  # terms that all of them have, about
TOGETHER = 256  # texts that meet a block together, at most
SPREAD = 512  # terms that are multiplied at once, at most
LOOKED_UP = 1 << 18  # postings that are added at once, about
DENSE = 128  # so many multiplications cost as much as one look-up
_SLACK = 1e-5  # more than the errors of the bounds, which are in single precision
_LEAST = 1e-7  # less than what one common term adds
Vectors = list[tuple[np.ndarray, np.ndarray]]  # term places and weights
PRIOR_WEIGHT = 0.2  # similarity that the rate without evidence is worth


def text_terms(runs: LetterRuns) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of every term: whole runs, and longer ones' first letters."""
    sizes = runs.ends - runs.starts
    owners, hashes = [runs.owner], [runs.hashes()]
    for prefix in PREFIXES:
        longer = sizes > prefix
        owners.append(runs.owner[longer])
        hashes.append(runs.hashes(prefix)[longer])
    return np.concatenate(owners), np.concatenate(hashes)


def _counted(texts: Texts, value: dict[str, Any]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, times) of the terms of each text, in order."""
    owners, hashes = text_terms(LetterRuns(texts, value["letters"]))
    order = np.lexsort((hashes, owners))
    owners, hashes = owners[order], hashes[order]
    first = np.flatnonzero(np.append(True, (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1]))) if len(owners) else np.zeros(0, np.int64)
    return owners[first], hashes[first], np.diff(np.append(first, len(owners)))


def example_terms(sample: DataFrame) -> DataFrame:
    """doc_id, label, the hashes of all terms of each text, and how often each occurs."""
    shared = sample.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = tables(shared)
        for batch in batches:
            for texts in slices(batch.column(2)):
                owners, hashes, times = _counted(texts, value)
                bounds = pa.array(np.searchsorted(owners, np.arange(len(texts) + 1)), pa.int32())
                rows = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.ListArray.from_arrays(bounds, pa.array(hashes.view(np.int64))),
                     pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32()))], ["doc_id", "label", "terms", "times"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sample.select("doc_id", "label").schema)
    return sample.select("doc_id", "label", "text").mapInArrow(lean(run), f"{fields}, terms array<bigint>, times array<int>")


def _known_terms(texts: Texts, value: dict[str, Any]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of each text, places of its terms that are known, times, whether it has any term)."""
    if "table" not in value:
        value["table"] = HashTable(value["terms"])
    owners, hashes = text_terms(LetterRuns(texts, value["letters"]))
    place = value["table"].find(hashes)
    hit, count = place >= 0, max(1, len(value["terms"]))
    keys, times = np.unique(owners[hit] * count + place[hit], return_counts=True)
    return np.searchsorted(keys, np.arange(len(texts) + 1) * count), keys % count, times, np.bincount(owners, minlength=len(texts)) > 0


def _portions(column: pa.Array, value: dict[str, Any]) -> Iterator[tuple[int, Vectors, list[bool]]]:
    """The first text, and for it and those that follow the places of the known terms and how often each occurs, and whether there is any term."""
    first, held = 0, 0
    asked: Vectors = []
    any_term: list[bool] = []
    for texts in slices(column):
        bounds, terms, times, filled = _known_terms(texts, value)
        asked += [(terms[a:b], times[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        any_term += filled.tolist()
        held += len(terms)
        if len(asked) >= PORTION or held >= PORTION_TERMS:
            yield first, asked, any_term
            first, held, asked, any_term = first + len(asked), 0, [], []
    if asked:
        yield first, asked, any_term


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of documents, and how many of them have each term."""
    shared = docs.sparkSession.sparkContext.broadcast({"terms": terms})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, n, found = tables(shared), 0, np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0)):
                _, places, _, _ = _known_terms(texts, value)
                found[:-1] += np.bincount(places, minlength=len(terms))
                found[-1] += len(texts)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int32()), "n": pa.array(found[at])})

    counted = docs.select("text").mapInArrow(lean(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term at most
    out = np.zeros(len(terms) + 1, np.int64)
    out[counted["term"].to_numpy()] = counted["n"].to_numpy()
    return int(out[-1]), out[:-1]


class BlockMaxIndex:
    """Weighted examples as postings by block, with the largest weight of each term in a block; a block holds examples of one kind."""

    def __init__(self, examples: Vectors, n_terms: int, block: int = BLOCK):
        """`examples`: term places and weights (of length one) of each example, in the order in which ties are broken."""
        sizes = [len(t) for t, _ in examples]
        terms = np.concatenate([t for t, _ in examples]).astype(np.int32) if sizes else np.zeros(0, np.int32)
        weights = np.concatenate([w for _, w in examples]) if sizes else np.zeros(0)
        common = np.bincount(terms, minlength=n_terms) > max(1, len(examples) / COMMON)
        self.common = np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)
        self._learn_kinds(examples)
        kind = self.kind_of(examples)
        self.order = np.argsort(kind, kind="stable")  # the example at each place
        self.place = np.argsort(self.order)
        counts = np.bincount(kind, minlength=1)
        rank = np.arange(len(examples)) - np.repeat(np.cumsum(counts) - counts, counts)
        blocks = -(-counts // block)
        in_block = np.repeat(np.cumsum(blocks) - blocks, counts) + rank // block  # of each place
        self.cuts = np.append(0, np.cumsum(np.bincount(in_block, minlength=1)))  # block b has the places cuts[b] to cuts[b + 1]
        self.n_blocks = len(self.cuts) - 1

        own_block = in_block[self.place]
        key = np.repeat(own_block, sizes)
        key += np.multiply(terms, self.n_blocks, dtype=np.int64)
        del terms
        self.most = np.zeros(n_terms * self.n_blocks, np.float32)
        np.maximum.at(self.most, key, weights.astype(np.float32))
        self.starts = np.append(0, np.cumsum(np.bincount(key, minlength=n_terms * self.n_blocks))).astype(np.int32)
        order = np.argsort(key, kind="stable")
        del key
        self.weights = weights[order]
        del weights
        self.examples = np.repeat((self.place - self.cuts[own_block]).astype(np.int32), sizes)[order]
        self.most = self.most.reshape(n_terms, self.n_blocks)

    def _learn_kinds(self, examples: Vectors) -> None:
        """Centres of some examples by their common terms. They say which go together and change no cosine."""
        vectors = self._common([examples[i] for i in np.unique(np.linspace(0, len(examples) - 1, KIND_EXAMPLES).astype(int)).tolist()] if examples else [])
        self.kinds = vectors[::-(-max(1, len(vectors)) // KINDS)]
        for _ in range(10 if len(vectors) else 0):
            own = np.argmax(vectors @ self.kinds.T, axis=1)
            sums = np.stack([vectors[own == i].sum(axis=0) for i in range(len(self.kinds))])
            self.kinds = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)

    def _common(self, asked: Vectors) -> np.ndarray:
        """What each has of the common terms, of length one."""
        out = np.zeros((len(asked), int(self.common.max(initial=-1)) + 1), np.float32)
        for row, (terms, weights) in zip(out, asked, strict=True):
            at = self.common[terms]
            row[at[at >= 0]] = weights[at >= 0]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)

    def kind_of(self, asked: Vectors) -> np.ndarray:
        if not len(self.kinds):
            return np.zeros(len(asked), np.int64)
        return np.concatenate([np.zeros(0, np.int64), *(np.argmax(self._common(asked[i:i + 1000]) @ self.kinds.T, axis=1) for i in range(0, len(asked), 1000))])

    def _postings(self, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return at

    def _scores(self, b: int, every: np.ndarray, uses: np.ndarray, which: np.ndarray, row: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """Products of n texts with the examples of a block; text row[i] has weights[i] of the term every[which[i]], which uses[which[i]] texts have."""
        first = self.starts[every * self.n_blocks + b].astype(np.int64)
        sizes = self.starts[every * self.n_blocks + b + 1] - first
        width = int(self.cuts[b + 1] - self.cuts[b])
        out = np.zeros((n, width))
        shared = np.flatnonzero(uses * sizes * DENSE > (n + 8) * width)
        column = np.full(len(every), -1)
        column[shared] = np.arange(len(shared))
        at = column[which]
        asked = np.zeros((n, len(shared)))
        asked[row[at >= 0], at[at >= 0]] = weights[at >= 0]
        spread = np.zeros((min(SPREAD, len(shared)), width))
        for start in range(0, len(shared), SPREAD):
            some = shared[start:start + SPREAD]
            found = self._postings(first[some], sizes[some])
            where = np.repeat(np.arange(len(some)) * width, sizes[some]) + self.examples[found]
            spread.ravel()[where] = self.weights[found]
            out += asked[:, start:start + SPREAD] @ spread[:len(some)]
            spread.ravel()[where] = 0
        others = np.flatnonzero((at < 0) & (sizes[which] > 0))
        first, sizes, row, weights = first[which[others]], sizes[which[others]], row[others] * width, weights[others]
        total = np.cumsum(sizes)
        cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, LOOKED_UP)), len(total)))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            found = self._postings(first[a:z], sizes[a:z])
            where = np.repeat(row[a:z], sizes[a:z])
            where += self.examples[found]
            np.add.at(out.ravel(), where, self.weights[found] * np.repeat(weights[a:z], sizes[a:z]))
        return out

    def _nearest_together(self, asked: Vectors, k: int, skip: list[int]) -> Vectors:
        n = len(asked)
        row = np.repeat(np.arange(n), [len(t) for t, _ in asked])
        terms, weights = np.concatenate([t for t, _ in asked]), np.concatenate([w for _, w in asked])
        every, which = np.unique(terms, return_inverse=True)
        uses = np.bincount(which, minlength=len(every))
        every = every.astype(np.int64)
        bounds = np.stack([np.bincount(row, weights * self.most[terms, b], n) for b in range(self.n_blocks)])
        left_out = [(i, int(self.place[x])) for i, x in enumerate(skip) if x >= 0]
        scores, best = np.zeros((n, int(self.cuts[-1]))), np.zeros((n, k))
        for b in np.argsort(-bounds.sum(axis=1), kind="stable").tolist():
            reach = (bounds[b] > 0) & (bounds[b] >= best.min(axis=1) - _SLACK)
            if not reach.any():
                continue
            use = np.flatnonzero(reach[row])
            own = self._scores(b, every, uses, which[use], (np.cumsum(reach) - 1)[row[use]], weights[use], int(reach.sum()))
            part = scores[:, self.cuts[b]:self.cuts[b + 1]]
            part[reach] = own
            for i, x in left_out:
                if self.cuts[b] <= x < self.cuts[b + 1]:
                    part[i, x - self.cuts[b]] = 0
            best[reach] = -np.partition(-np.concatenate([best[reach], part[reach]], axis=1), k - 1, axis=1)[:, :k]
        row, at = np.nonzero(scores >= np.maximum(best.min(axis=1, keepdims=True) - _SLACK, _LEAST))
        found, cosines = self.order[at], np.round(scores[row, at], 12)
        order = np.lexsort((found, -cosines, row))
        bounds = np.searchsorted(row, np.arange(n + 1)).tolist()
        return [(found[order[a:z][:k]], cosines[order[a:z][:k]]) for a, z in zip(bounds[:-1], bounds[1:])]

    def nearest_of(self, asked: Vectors, k: int, skip: list[int] | None = None) -> Vectors:
        """(examples, cosines) of the k nearest with a common term of each of many term vectors, without the example to skip."""
        out: Vectors = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
        kind = self.kind_of(asked)
        for i in np.unique(kind).tolist():
            own = np.flatnonzero(kind == i).tolist()
            for start in range(0, len(own), TOGETHER):
                part = own[start:start + TOGETHER]
                for x, near in zip(part, self._nearest_together([asked[x] for x in part], k, [skip[x] for x in part] if skip else []), strict=True):
                    out[x] = near
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(terms, weights)], k, [skip])[0]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing step function nearest to y, by pooling neighbours that are out of order."""
    order = np.argsort(x, kind="stable")
    points, at = np.unique(x[order], return_inverse=True)
    value = np.bincount(at, y[order]) / np.bincount(at)
    pools: list[list[float]] = []
    for p, v, w in zip(points, value, np.bincount(at), strict=True):
        pools.append([v, w, p, p])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, _, last = pools.pop()
            v1, w1, first, _ = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, first, last])
    xs = np.array([p for pool in pools for p in pool[2:]])
    ys = np.array([pool[0] for pool in pools for _ in range(2)])
    return xs, ys


class Votes:
    """Scores of term vectors by their nearest examples."""

    def __init__(self, model: dict[str, Any]):
        self.term_weights, self.labels, self.rate, self.blank = model["term_weights"], model["labels"], model["rate"], model["blank"]
        at = np.cumsum([0, *model["sizes"]])
        self.texts = [(model["places"][a:b], model["times"][a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        self.index = BlockMaxIndex([(t, weigh(self.term_weights, t, times)) for t, times in self.texts], len(self.term_weights))

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> Iterator[tuple[float, np.ndarray]]:
        """(share of toxic votes, the nearest examples) of texts as the places of their terms and how often each occurs."""
        asked = [(terms, weigh(self.term_weights, terms, times)) for terms, times in texts]
        for near, cosines in self.index.nearest_of(asked, NEIGHBOURS, skip):
            yield float((cosines @ self.labels[near] + PRIOR_WEIGHT * self.rate) / (cosines.sum() + PRIOR_WEIGHT)), near

    def left_out(self, which: list[int]) -> list[float]:
        """Shares of some examples, each without its own vote."""
        return [share for share, _ in self.votes([self.texts[i] for i in which], which)]


def votes_of(shared: Broadcast) -> Votes:
    """The index over the broadcast examples, which each worker process builds once."""
    if "votes" not in shared.value:
        shared.value["votes"] = Votes(shared.value)
    return shared.value["votes"]


def calibration(spark: SparkSession, shared: Broadcast, labels: np.ndarray, blank: float, empty: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The curve from shares to scores, learned from all examples; the index is built in the tasks, not on the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = votes_of(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes.left_out(batch.column(0).to_pylist()), pa.float64())], ["id", "share"])

    found = spark.range(0, len(labels), 1, max(1, len(labels) // 500)).mapInArrow(run, "id long, share double").toArrow().sort_by("id")  # a row for each example
    return isotonic(np.concatenate([found["share"].to_numpy(), np.full(len(empty), blank)]), np.concatenate([labels, np.array(empty, float)]))


def weigh(term_weights: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
    w = (1 + np.log(times)) * term_weights[terms]
    return w / np.linalg.norm(w) if len(w) else w


def learn(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = TRAINING_TEXTS) -> dict[str, Any]:
    """The examples and what is known of their terms; nothing without toxic examples.

    Of the labelled ids that are usable, those with the smallest hashes are taken, at most `limit`.
    """
    chosen = (labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    chosen = staged_table(chosen, "toxic_sample")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    sample = staged_table(sample, "toxic_texts")
    totals = sample.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not totals.n or not totals.toxic:
        return {}
    if totals.n > 4 * limit:  # only repeated ids make more rows than `limit`
        sample = sample.orderBy("doc_id", "text").limit(4 * limit)
    own = example_terms(sample).toArrow()
    rows = sorted(((i, x, t.values.to_numpy().view(np.uint64), n.values.to_numpy()) for i, x, t, n in
                   zip(own["doc_id"].to_pylist(), own["label"].to_pylist(), own["terms"], own["times"], strict=True)), key=lambda x: (x[0], blake2b(x[2].tobytes() + x[3].tobytes()).digest()))
    filled, empty = [x for x in rows if len(x[2])], [x[1] for x in rows if not len(x[2])]
    every = np.concatenate([t for _, _, t, _ in filled]) if filled else np.zeros(0, np.uint64)
    terms, places = np.unique(every, return_inverse=True)
    places = places.astype(np.int32)
    del own, every
    sizes, marks = [len(t) for _, _, t, _ in filled], np.array([x for _, x, _, _ in filled], float)
    toxic = np.bincount(places, np.repeat(marks, sizes), len(terms))
    clean = np.bincount(places, minlength=len(terms)) - toxic
    times = np.concatenate([t for *_, t in filled]).astype(np.int32) if filled else np.zeros(0, np.int32)
    ids = [x[0] for x in filled]
    del rows, filled
    release()
    n_docs, df = document_frequencies(docs, terms)
    term_weights = (np.log((1 + n_docs) / (1 + df)) + 1) * np.log2(2 + toxic / np.maximum(1, clean))
    rate = totals.toxic / totals.n
    return {"terms": terms, "term_weights": term_weights, "labels": marks, "ids": ids, "rate": rate, "empty": empty,
            "blank": (sum(empty) + rate) / (len(empty) + 1), "places": places, "times": times, "sizes": sizes}


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """doc_id, score, predicted, and as `evidence` the ids of the three nearest examples, nearest first."""
    model = learn(docs, labels, usable)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not model:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(f"array<{kind}>").alias("evidence"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    marks, blank, empty = model["labels"], model["blank"], model["empty"]
    model.clear()  # the executors have it; the driver needs it no longer
    release()
    curve = calibration(docs.sparkSession, shared, marks, blank, empty)
    id_type = pa.int64() if kind == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, votes = tables(shared), votes_of(shared)
        for batch in batches:
            for first, asked, any_term in _portions(batch.column(1), value):
                scores, evidence = [], []
                for filled, (share, near) in zip(any_term, votes.votes(asked), strict=True):
                    scores.append(float(np.interp(share if filled else votes.blank, *curve)))
                    evidence.append([value["ids"][j] for j in near[:3].tolist()])
                found = np.clip(np.array(scores), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(asked)), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32)),
                     pa.array(evidence, pa.list_(id_type) if id_type else None)], ["doc_id", "score", "predicted", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, score double, predicted int, evidence array<{kind}>")
