from __future__ import annotations

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest_llm import EDGE_TEXTS
from kartoteka.llm import packing
from kartoteka.llm.byte_bpe import read_merges
from kartoteka.registry.base import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return read_merges(PATH)


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return out


def check(docs, rows, library, size):
    """Every id of every document in exactly one piece; sequences gapless and full at most."""
    expected = []
    for r in docs.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        expected.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        whole = len(ids) // size * size
        cuts = [*range(0, whole + 1, size), *([whole + size // 2] if len(ids) - whole >= size // 2 else []), len(ids)]
        for k, end in zip(cuts, cuts[1:]):
            part = ids[k:end]
            if not len(part):
                continue
            expected.append((r.doc_id, k, len(part), zlib.crc32(part.tobytes()), len(ids)))
    pieces = [e for e in expected if len(e) == 5]
    assert sorted(map(repr, pieces)) == sorted(repr(tuple(r)[:5]) for r in rows)
    by_sequence = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    for _, group in itertools.groupby(by_sequence, key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= size
    return sum(r.length for r in rows) / (size * max(1, len({r.sequence_id for r in rows})))


def test_documents_are_packed_whole_and_tightly(spark, vocabulary, library):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert check(docs, packing.pack(docs, vocabulary).collect(), library, 1024) > 0.97


def test_edge_texts(documents, vocabulary, library):
    docs = documents([*EDGE_TEXTS, (None, "no id"), (None, "no id"), *["same text here"] * 50])
    check(docs, packing.pack(docs, vocabulary, size=16).collect(), library, 16)
    assert packing.pack(documents([]), vocabulary).count() == 0
    ids = library.encode("a b c d e f g", add_special_tokens=False).ids
    exact = documents(["a b c d e f g"])
    assert [r.length for r in packing.pack(exact, vocabulary, size=len(ids) + 1, unit=1).collect()] == [len(ids) + 1]


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(2, 13), 4, replace=False))
        prices = rng.random(4)
        value, pattern = packing.best_pattern(prices, lengths, 20)
        best = max(sum(p * n for p, n in zip(prices, counts)) for counts in itertools.product(range(11), repeat=4)
                   if sum(a * n for a, n in zip(lengths, counts)) <= 20)
        assert value == pytest.approx(best) and sum(prices[k] * n for k, n in pattern.items()) == pytest.approx(value)


def test_linear_program_reaches_its_bound():
    patterns = packing.plan({34: 700, 33: 900, 50: 400, 16: 1200}, 100)
    used = {}
    for pattern, times in patterns.items():
        assert sum(a * n for a, n in pattern) <= 100
        for a, n in pattern:
            used[a] = used.get(a, 0) + n * times
    assert used == {34: 700, 33: 900, 50: 400, 16: 1200}
    assert sum(patterns.values()) <= 1.02 * (34 * 700 + 33 * 900 + 50 * 400 + 16 * 1200) / 100
