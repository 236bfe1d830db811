from __future__ import annotations

import itertools
import math
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest_llm import EDGE_TEXTS
from kartoteka.llm import language
from kartoteka.llm.queries import op4_language
from kartoteka.registry.base import table

PIECES = ["▁", "▁a", "a", "ab", "abc", "b", "bc", "c", "▁ab"]


def segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        yield [word[a:b] for a, b in zip(edges, edges[1:])]


@pytest.fixture(scope="module")
def probabilities():
    p = np.random.default_rng(2).random((len(PIECES) + 1, 3)) / 10
    p[-1] = language.UNKNOWN
    return p


def brute(word, p, k):
    total, uses = 0.0, np.zeros(len(p))
    for parts in segmentations("▁" + word):
        ids = [PIECES.index(x) if x in PIECES else len(PIECES) if len(x) == 1 else -1 for x in parts]
        if -1 not in ids:
            q = np.prod([p[i, k] for i in ids])
            total += q
            for i in ids:
                uses[i] += q
    return total, uses / total


@pytest.mark.parametrize("word", ["a", "abc", "abcabcab", "xaz", "zzz"])
def test_all_segmentations_are_summed(word, probabilities):
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    table_ = language.piece_table(PIECES)
    got = language.word_scores(points, np.array([0]), np.array([len(word)]), table_, probabilities)[0]
    for k in range(3):
        total, uses = brute(word, probabilities, k)
        assert got[k] == pytest.approx(np.log(total))
        expected = language.expected_uses([word], np.array([2.0]), table_, probabilities[:, k:k + 1])
        assert expected == pytest.approx(2 * uses)


def plain(word, pieces, p, k):
    """Log of the sum over all segmentations, in exact arithmetic."""
    word = "▁" + word
    sums = [Fraction(1)]
    for j in range(1, len(word) + 1):
        total = Fraction(0)
        for i in range(j):
            part = word[i:j]
            if part in pieces or len(part) == 1:
                total += sums[i] * Fraction(float(p[pieces.index(part) if part in pieces else -1, k]))
        sums.append(total)
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_long_pieces_and_runs_as_wholes():
    pieces = [*PIECES, "abcabcabcabc", "▁cabcabcabcabca", "bcabcabc"]
    p = np.random.default_rng(3).random((len(pieces) + 1, 2)) / 1e4
    p[-1] = language.UNKNOWN
    words = ["abc" * 20, "cabcabcabcabcabca", "z" * 61, "a", "abcabcabcabc" * 13 + "zz", "b", "zabcabcabcabcz", "ab" * 200]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    got = language.word_scores(points, ends - [len(w) for w in words], ends, language.piece_table(pieces), p)
    for word, scores in zip(words, got):
        assert scores == pytest.approx([plain(word, pieces, p, k) for k in range(2)])
    assert language.word_scores(points, ends[:0], ends[:0], language.piece_table(pieces), p).shape == (0, 2)


def test_all_letter_pieces_of_the_vocabulary_are_read():
    pieces = language.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert max(map(len, pieces)) > 12 and len(pieces) == len(set(pieces))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = op4_language(spark, folder).join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_texts(spark, documents):
    pieces = language.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    docs = documents([*EDGE_TEXTS, "x" * 1_000 + " 中文", "123 !?", (None, "le de la"), (50, "bonjour le monde et la vie"), (51, "the house and the garden")])
    taught = docs.withColumn("lang", F.when(F.col("doc_id") == 50, "fr").when(F.col("doc_id") == 51, "en"))
    model = language.learn(taught, F.lit(True), pieces)
    rows = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, model).collect()]
    assert len(rows) == docs.count()
    by_id = {i: (p, s) for i, p, s in rows}
    for i in (0, 1, 2, 12):
        assert by_id[i] == ("und", 0.0)
    assert by_id[3] == by_id[4] and by_id[7] == by_id[8] and by_id[50][0] == "fr" and by_id[51][0] == "en" and by_id[None][0] == "fr"
    untaught = language.learn(docs, F.lit(True), pieces)
    assert {(r.lang_pred, r.score) for r in language.predict(docs, untaught).collect()} == {("und", 0.0)}
    assert language.predict(docs.limit(0), model).count() == 0
