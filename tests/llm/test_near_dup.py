from __future__ import annotations

import random
import re

import numpy as np
import pytest

from conftest_llm import EDGE_TEXTS
from kartoteka.llm import near_dup
from kartoteka.registry.base import table


def brute(docs):
    """{doc_id: (set size, smallest id reachable)} over all pairs."""
    sets = {}
    for r in docs.collect():
        if r.doc_id is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
            words = re.findall("[^\x20\x09-\x0d]+", text)
            sets[r.doc_id] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    owners = {}
    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    pairs = {(a, b) for o in owners.values() for k, a in enumerate(o) for b in o[k + 1:]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(docs):
    expected = brute(docs)
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    return rows


def test_documents_match_all_pairs(spark):
    rows = check(table(spark, "/root/testdata/sf0.01", "documents"))
    assert sum(not r.kept for r in rows) > 30


def test_edge_texts(documents):
    check(documents([*EDGE_TEXTS, "One  TWO three", "one two three", (None, "a"), (None, "a")]))
    assert near_dup.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("small, block", [(24, 2048), (2, 16)])
def test_groups_of_copies_and_chains(documents, monkeypatch, small, block):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(7)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        return words

    near = [" ".join(edited(base, rng.randrange(0, 4))) for _ in range(150)]
    chain, words = [], [f"c{i}" for i in range(100)]
    for k in range(30):  # each is near the one before only
        chain.append(" ".join(words))
        words = [*words[4:], *[f"d{k}_{j}" for j in range(4)]]
    half = [" ".join([*base[:60], *[f"h{k}_{j}" for j in range(40)]]) for k in range(40)]  # a shared passage, no link
    texts = near + chain + half + [" ".join(base)] * 60
    rng.shuffle(texts)
    rows = check(documents(texts))
    assert len({r.component_id for r in rows}) >= 41


@pytest.mark.parametrize("share", [0.2, 0.75])
def test_registers_estimate_similarity(share):
    rng = np.random.default_rng(3)
    both = rng.integers(0, 2**63, int(4000 * share)).astype(np.uint64)
    rest = int(4000 * (1 - share) / 2)
    sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, rest).astype(np.uint64)])) for _ in range(2)]
    a, b = near_dup.registers(sets)
    n = np.array([float(len(sets[0]))])
    chance = near_dup.collision_rate(n, n)[0]
    assert 0 < chance < 0.001 and abs(((a == b).mean() - chance) / (1 - chance) - share) < 0.15
    least = np.array([1 << 63, (1 << 63) | (1 << 53), 1 << 40, (1 << 40) + (1 << 39)], np.uint64)
    assert near_dup.compress(least).tolist() == [0, 1, 23 << 10, (23 << 10) | 512]
