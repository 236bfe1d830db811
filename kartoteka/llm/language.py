"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary. A word may be cut
into pieces in many ways; its probability is the sum over all of them, which the forward
algorithm finds in time linear in its length. Probabilities are learned by expectation
maximisation: the expected number of times a piece is used, over all segmentations of the words
of a bounded sample of texts. A text's score is the posterior of its best language.

Words are runs of letters, in lower case, with a mark in front. Pieces are as long as the vocabulary
has them, and a word of any length is scored as a whole: of the sums so far only as many are kept as
the longest piece has letters, rescaled on the way. All words of a slice are scored at once as arrays,
each distinct word once. Learning alone counts uses in parts of `TAUGHT` letters of a run.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every
text if nothing can be learned; ties go to the first language by name; equal texts get equal
results. Columns besides `doc_id`, `text` and (to learn) `lang` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.llm.letters import HashTable, LetterRuns, tables
from kartoteka.llm.memory import lean
from kartoteka.llm.spans import mix, slices
from kartoteka.operators.tables import staged_table

TRAINING_TEXTS = 300  # labelled texts of each language that are learned from, at most
ROUNDS = 3
TAUGHT = 24  # letters of the parts that long runs are learned from
RESCALED = 8  # letters from one rescaling to the next
UNKNOWN = 1e-7  # probability of a letter that is no piece
UNDETERMINED = "und"
_MARK = ord("▁")
_CACHED, _TOGETHER = 200_000, 20_000


def read_pieces(path: str) -> list[str]:
    """Pieces of letters, with the word mark at their front if at all, from a sentencepiece model."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.vocab_size()))
    return sorted({p for p in pieces if p.lstrip("▁").isalpha() and len(p) - len(p.lstrip("▁")) <= 1} | {"▁"})


def _hash_step(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + points.astype(np.uint64))


def piece_table(pieces: Sequence[str]) -> HashTable:
    """Pieces by a hash that takes their letters from the last to the first; `longest` is the most letters of one."""
    keys = []
    for piece in pieces:
        key = np.zeros(1, np.uint64)
        for c in reversed(piece):
            key = _hash_step(key, np.array([ord(c)]))
        keys.append(key[0])
    table = HashTable(np.array(keys, np.uint64))
    table.longest = max(map(len, pieces), default=1)
    return table


def _matches(words: np.ndarray, table: HashTable, unknown: int) -> np.ndarray:
    """Piece at [m, w, i]: of m + 1 letters from place i of word w, -1 if none; single letters are always found."""
    count, size = words.shape
    most = min(table.longest, size)
    out = np.full((most, count, size), -1, np.int32)
    keys = np.zeros((count, size + 1), np.uint64)
    for m in range(most):
        keys = _hash_step(keys[:, 1:], words[:, :size - m])
        out[m, :, :size - m] = table.find(keys.ravel()).reshape(keys.shape)
    out[0][out[0] < 0] = unknown
    return out


def forward(words: np.ndarray, table: HashTable, probabilities: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alpha [place, word, language], matches, probabilities with a last row of zeros) of words of one length.

    The last row but one of the probabilities is that of a letter that is no piece.
    """
    count, size = words.shape
    matches = _matches(words, table, len(probabilities) - 1)
    p = np.vstack([probabilities, np.zeros((1, probabilities.shape[1]))])  # -1 is the row of zeros
    alpha = np.zeros((size + 1, count, probabilities.shape[1]))
    alpha[0] = 1
    for j in range(1, size + 1):
        for m in range(min(len(matches), j)):
            alpha[j] += alpha[j - m - 1] * p[matches[m, :, j - m - 1]]
    return alpha, matches, p


def _by_length(lengths: np.ndarray, most: int = 20_000) -> Iterator[tuple[int, np.ndarray]]:
    for size in np.unique(lengths).tolist():
        found = np.flatnonzero(lengths == size)
        for k in range(0, len(found), most):
            yield size, found[k:k + most]


def _with_mark(points: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    words = np.full((len(starts), size + 1), _MARK, np.uint32)
    words[:, 1:] = points[starts[:, None] + np.arange(size)]
    return words


def word_scores(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: HashTable, probabilities: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(starts), probabilities.shape[1]))
    order = np.argsort(starts - ends, kind="stable")  # longest first: words that go on are the first ones
    for k in range(0, len(order), _TOGETHER):
        which = order[k:k + _TOGETHER]
        out[which] = _sums(points, starts[which], ends[which] - starts[which], table, probabilities)
    return out


def _sums(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: HashTable, probabilities: np.ndarray) -> np.ndarray:
    """The same for words by falling length, letter by letter, with a window of sums."""
    out = np.empty((len(starts), probabilities.shape[1]))
    scale = np.zeros_like(out)
    window = [np.ones_like(out)]  # sums up to each of the last places, newest first
    going = np.searchsorted(-lengths, -np.arange(lengths.max(initial=0) + 2), side="right")  # words of at least so many letters
    for j in range(int(lengths.max(initial=0)) + 1):  # place 0 is the mark, place j the letter j - 1
        n = going[j]
        keys = np.zeros((min(table.longest, j + 1), n), np.uint64)
        for m in range(len(keys)):
            letters = np.full(n, _MARK, np.uint32) if j == m else points[starts[:n] + (j - m - 1)]
            keys[m] = _hash_step(keys[m - 1] if m else keys[0], letters)
        found = table.find(keys.ravel()).reshape(keys.shape)
        found[0][found[0] < 0] = len(probabilities) - 1
        total = window[0][:n] * probabilities[found[0]]
        for m in range(1, len(keys)):
            at = np.flatnonzero(found[m] >= 0)
            if len(at):
                total[at] += window[m][at] * probabilities[found[m, at]]
        window = [total, *window[:table.longest - 1]]
        if j % RESCALED == RESCALED - 1:
            scale[:n] += np.log(total)
            window = [w[:n] / total for w in window]
        done = slice(going[j + 1], n)
        out[done] = np.log(window[0][done]) + scale[done]
    return out


def expected_uses(words: Sequence[str], counts: np.ndarray, table: HashTable, probabilities: np.ndarray) -> np.ndarray:
    """How often each piece is expected to be used by the words, weighted by their counts, for one language."""
    uses = np.zeros(len(probabilities))
    lengths = np.array([len(w) for w in words])
    for size, which in _by_length(lengths, 5_000):
        points = np.frombuffer("".join(words[i] for i in which).encode("utf-32-le"), np.uint32)
        grid = _with_mark(points, np.arange(len(which)) * size, size)
        alpha, matches, p = forward(grid, table, probabilities)
        weight = counts[which] / alpha[-1, :, 0]
        size += 1
        beta = np.zeros((size + 1, len(which)))
        beta[size] = 1
        for i in range(size - 1, -1, -1):
            for m in range(min(len(matches), size - i)):
                beta[i] += p[matches[m, :, i], 0] * beta[i + m + 1]
        for m in range(len(matches)):
            for i in range(size - m):
                found = matches[m, :, i]
                used = alpha[i, :, 0] * p[found, 0] * beta[i + m + 1] * weight
                uses += np.bincount(found[found >= 0], used[found >= 0], len(uses))
    return uses


def _training_words(sample: DataFrame, shared) -> DataFrame:
    """(language, word, count) of the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = tables(shared)["letters"]
        for batch in batches:
            languages = batch.column(0).to_pylist()
            for texts in slices(batch.column(1)):
                runs = LetterRuns(texts, letters, TAUGHT)
                text = runs.points.astype(np.uint32).tobytes().decode("utf-32-le")
                counted: dict[tuple[str, str], int] = {}
                for i, a, b in zip(runs.owner.tolist(), runs.starts.tolist(), runs.ends.tolist(), strict=True):
                    key = (languages[texts.first + i], text[a:b])
                    counted[key] = counted.get(key, 0) + 1
                yield pa.RecordBatch.from_pydict({"language": pa.array([k[0] for k in counted], pa.string()),
                                                  "word": pa.array([k[1] for k in counted], pa.string()),
                                                  "n": pa.array(list(counted.values()), pa.int64())})

    return sample.select("lang", "text").mapInArrow(lean(run), "language string, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, usable: Column, pieces: Sequence[str], limit: int = TRAINING_TEXTS) -> dict[str, Any]:
    """Languages and their piece probabilities, from at most `limit` texts of each language.

    Of each language those texts are taken whose ids have the smallest hashes.
    """
    spark = docs.sparkSession
    ranked = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = (docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
              .withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= limit).select("doc_id", "lang"))
    chosen = staged_table(sample, "language_sample")
    shared = spark.sparkContext.broadcast({})
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen.distinct()), ["doc_id", "lang"], "left_semi")
    words = staged_table(_training_words(texts, shared), "language_words")
    languages = sorted(r.language for r in words.select("language").distinct().collect())
    table = piece_table(pieces)
    uses = np.ones((len(pieces) + 1, len(languages)))
    for _ in range(ROUNDS if languages else 0):
        uses = _expected(words, languages, table, _normalised(uses))
    return {"languages": languages, "table": table.__dict__, "probabilities": _normalised(uses)}


def _normalised(uses: np.ndarray) -> np.ndarray:
    p = uses + 0.02
    p /= p.sum(axis=0, keepdims=True)
    p[-1] = UNKNOWN
    return p


def _expected(words: DataFrame, languages: Sequence[str], table: HashTable, probabilities: np.ndarray) -> np.ndarray:
    shared = words.sparkSession.sparkContext.broadcast({"table": table.__dict__, "p": probabilities})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = HashTable.__new__(HashTable)
        found.__dict__.update(shared.value["table"])
        total = np.zeros_like(shared.value["p"])
        for batch in batches:
            own, of = batch.column(1).to_pylist(), np.array(batch.column(0).to_pylist())
            counts = batch.column(2).to_numpy()
            for k, language in enumerate(languages):
                which = np.flatnonzero(of == language)
                if len(which):
                    total[:, k] += expected_uses([own[i] for i in which], counts[which], found, shared.value["p"][:, k:k + 1])
        piece, language = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "language": pa.array(language, pa.int32()),
                                          "uses": pa.array(total[piece, language])})

    summed = words.select("language", "word", "n").mapInArrow(lean(run), "piece int, language int, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses"))
    rows = summed.toPandas()  # at most a row for each piece and language
    out = np.zeros_like(probabilities)
    out[rows["piece"], rows["language"]] = rows["uses"]
    return out


def _scorer(value: dict[str, Any]):
    """Log probabilities of the runs of a slice; words met before are looked up."""
    if "known" not in value:
        table = HashTable.__new__(HashTable)
        table.__dict__.update(value["table"])
        value["known"] = (np.zeros(0, np.uint64), np.zeros((0, len(value["languages"]))), table)

    def score(runs: LetterRuns) -> np.ndarray:
        keys, scores, table = value["known"]
        hashes, first, inverse = np.unique(runs.hashes(), return_index=True, return_inverse=True)
        if len(keys) > _CACHED:
            keys, scores = keys[:0], scores[:0]
        place = np.searchsorted(keys, hashes)
        known = place < len(keys)
        known[known] = keys[place[known]] == hashes[known]
        fresh = first[~known]
        out = np.empty((len(hashes), len(value["languages"])))
        out[known] = scores[place[known]]
        out[~known] = word_scores(runs.points, runs.starts[fresh], runs.ends[fresh], table, value["probabilities"])
        keys = np.concatenate([keys, hashes[~known]])
        order = np.argsort(keys, kind="stable")
        value["known"] = keys[order], np.concatenate([scores, out[~known]])[order], table
        return out[inverse]

    return score


def predict(docs: DataFrame, model: dict[str, Any]) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    languages = model["languages"]
    shared = docs.sparkSession.sparkContext.broadcast(dict(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = tables(shared)
        score = _scorer(value)
        for batch in batches:
            for texts in slices(batch.column(1)):
                runs = LetterRuns(texts, value["letters"])
                filled = (np.diff(runs.bounds) > 0) & bool(languages)
                names, best = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
                if filled.any():
                    each = score(runs)
                    total = np.stack([np.bincount(runs.owner, each[:, k], len(texts)) for k in range(len(languages))], axis=1)[filled]
                    posterior = np.exp(total - total.max(axis=1, keepdims=True))
                    names[filled] = np.array(languages, object)[posterior.argmax(axis=1)]
                    best[filled] = 1 / posterior.sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)), pa.array(names.tolist(), pa.string()), pa.array(best)],
                    ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double")
