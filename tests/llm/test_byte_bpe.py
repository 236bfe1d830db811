from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from conftest_llm import EDGE_TEXTS
from kartoteka.llm import byte_bpe
from kartoteka.llm.spans import slices
from kartoteka.registry.base import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.read_ranks(RANKS)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(n, seed=1):
    rng, alphabet = random.Random(seed), "ab sStTmd'rvel1²٣ \n\t 　é中!?.'' ''\x1c\u0085😀"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [
        "", "a" * 5_000, "ab" * 300 + "'s" * 50, "\n" * 100, " " * 99 + "x", "<|endoftext|>"]


def encode(encoder, texts):
    out = []
    for part in slices(pa.array(texts), 10_000):
        got = encoder.encode(part)
        assert encoder.decode(got.ids).tobytes() == part.data.tobytes()
        out += [got.ids[a:b].tolist() for a, b in zip(got.bounds, got.bounds[1:])]
    return out


def test_ids_equal_the_library(vocabulary, reference):
    texts = fuzz(5_000)
    assert encode(byte_bpe.Encoder(vocabulary), texts) == [reference.encode_ordinary(t) for t in texts]


def test_a_full_cache_changes_nothing(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 50)
    texts = fuzz(300, seed=2)
    assert encode(byte_bpe.Encoder(vocabulary), texts) == [reference.encode_ordinary(t) for t in texts]


def test_listed_merges_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = fuzz(3_000, seed=3)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode(byte_bpe.Encoder(byte_bpe.read_merges(path)), texts) == expected


def test_scan_equals_stepping():
    symbols = np.random.default_rng(1).integers(0, 16, 3_000).astype(np.uint8)
    state, states = byte_bpe.START, []
    for s in symbols.tolist():
        states.append(state)
        state = byte_bpe._step(byte_bpe.START if s > 7 else state, s % 8)[0]
    assert byte_bpe.scan_states(symbols, 64).tolist() == states


def digests(reference, text):
    ids = reference.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_documents(spark, vocabulary, reference, documents):
    for docs in (table(spark, "/root/testdata/sf0.001", "documents"), documents(EDGE_TEXTS + [(None, "no id")]), documents([])):
        expected = sorted((repr(r.doc_id), *digests(reference, r.text)) for r in docs.collect())
        assert sorted((repr(a), *rest) for a, *rest in byte_bpe.digest_documents(docs, vocabulary).collect()) == expected


def test_round_trip_and_offsets(spark, vocabulary, documents):
    docs = documents(["don't stop", "é中😀 x", None, ""])
    encoded = byte_bpe.encode_documents(docs, vocabulary)
    assert {r.doc_id: r.text for r in byte_bpe.decode_documents(encoded, vocabulary).collect()} == {0: "don't stop", 1: "é中😀 x", 2: "", 3: ""}
    tokens = vocabulary["tokens"]
    for r in encoded.collect():
        assert r.offsets == [sum(len(tokens[i]) for i in r.ids[:k]) for k in range(len(r.ids))]
