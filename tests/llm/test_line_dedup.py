from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from conftest_llm import EDGE_TEXTS
from kartoteka.llm import line_dedup
from kartoteka.llm.spans import slices
from kartoteka.registry.base import table


def removed(docs):
    """Checks what must hold for any result; {doc_id: removed bytes}."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    everything = sorted((i, t.encode()) for i, t in texts.items() if t is not None and i is not None)
    out = {}
    rows = line_dedup.remove_repeated(docs).collect()
    assert len(rows) == docs.count()
    left = {r.doc_id: (r.text or "").encode() for r in rows}
    for r in rows:
        if r.doc_id is None or r.text is None:
            assert r.text == texts[r.doc_id] and not r.removed_spans
            continue
        raw, rest, at = texts[r.doc_id].encode(), b"", 0
        for s in r.removed_spans:
            span = raw[s.start:s.end]
            assert len(span.split()) >= line_dedup.MIN_WORDS
            # every line that went still stands somewhere, and stood before
            starts, bodies, _ = (x.tolist() for x in line_dedup.lines(next(slices(pa.array([span.decode()])))))
            for a, b in zip(starts, bodies):
                assert any(span[a:b] in t for t in left.values()), span[a:b]
                assert any(i < r.doc_id and span[a:b] in t or i == r.doc_id and t.index(span[a:b]) < s.start + a for i, t in everything if span[a:b] in t)
            rest, at = rest + raw[at:s.start], s.end
        assert (rest + raw[at:]).decode() == r.text
        out[r.doc_id] = b"".join(raw[s.start:s.end] for s in r.removed_spans)
    return out


def prose(rng, n, tag):
    words = []
    for k in range(n):
        words.append(f"{tag}{rng.randrange(10**6)}" + rng.choice(["", "", "", ",", ".", ".\n"]))
    return " ".join(words)


def test_documents(spark):
    assert sum(map(bool, removed(table(spark, "/root/testdata/sf0.001", "documents")).values())) > 0


def test_planted_passages_go_and_clean_documents_stay(documents):
    rng = random.Random(5)
    passages = [prose(rng, 60, f"p{k}_") + "." for k in range(40)]
    texts, planted = [], {}
    for i in range(200):
        body = [prose(rng, 30, f"d{i}_") + ". ", prose(rng, 30, f"e{i}_") + "."]
        if i % 2:
            planted[i] = i % 40
            body.insert(1, passages[i % 40] + " ")
        texts.append("".join(body))
    gone = removed(documents(texts))
    seen, caught, expected = set(), 0, 0
    for i in range(200):
        if i not in planted:
            assert not gone[i]
        elif planted[i] in seen:
            expected += 60
            words = gone[i].decode().split()
            caught += len(words)
            assert {w.rstrip(".,") for w in words} - {""} <= {w.rstrip(".,") for w in passages[planted[i]].split()}
        else:
            seen.add(planted[i])
            assert not gone[i]
    assert caught >= 0.9 * expected


def test_a_moved_passage_has_the_same_chunks():
    passage = prose(random.Random(1), 400, "x")
    a, b = (set(line_dedup.chunks(next(slices(pa.array([t]))))[1].tolist()) for t in (passage, "some other words, here. And\nmore. " + passage))
    assert len(a & b) >= 0.9 * len(a)


def test_edge_texts(documents):
    same = "one two three four, five six seven eight.\nnine ten eleven twelve"
    gone = removed(documents([*EDGE_TEXTS, same, same, (None, same), same + "\n\n" + same]))
    assert gone[12] == same.encode() and not gone[11] and len(gone[14]) >= len(same)
    assert line_dedup.remove_repeated(documents([])).count() == 0


def test_columns_stay(documents):
    docs = documents(["a b c d e, f g h i. j k l m"] * 3)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted((r.doc_id, r.text, r.n_chars, r.score) for r in out.collect())[1:] == [(1, "", 0, "x"), (2, "", 0, "x")]


def words_of(rng, n, tag):
    return " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(n))


def test_no_passage_of_the_stated_size_is_missed(documents):
    rng = random.Random(11)
    passages = []
    for k in range(150):
        clauses = []
        while sum(c.count(" ") + 1 for c in clauses) < line_dedup.SURE + k % 20:
            clauses.append(words_of(rng, rng.randrange(2, 12), f"p{k}_") + rng.choice([",", ".", ";"]))
        passages.append(" ".join(clauses))
    texts = [f"{words_of(rng, 9, 'd')}. {words_of(rng, 3, 'e')}, {passages[i % 150]} {words_of(rng, 12, 'f')}." for i in range(300)]
    gone = removed(documents(texts))
    assert not any(gone[i] for i in range(150))
    assert all(gone[i].decode().strip() == passages[i % 150] for i in range(150, 300))


def test_words_without_lines(documents):
    rng = random.Random(12)
    passages = [words_of(rng, 50, f"p{k}_") for k in range(40)]
    texts = [f"{words_of(rng, 30, 'd')} {passages[i % 40]} {words_of(rng, 30, 'f')}" for i in range(80)]
    gone = removed(documents(texts))
    assert all(gone[i].decode() == (passages[i % 40] if i >= 40 else "") for i in range(80))
    line = words_of(rng, 35, "x") + "."
    gone = removed(documents([line, f"Some words. {line} Others"]))
    assert gone == {0: b"", 1: line.encode() + b" "}


def test_text_without_blanks(documents):
    rng = random.Random(13)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    lines, plain = "".join(han(7) + "。" for _ in range(4)), han(60)
    docs = documents([f"{han(9)}。{lines}{han(9)}", f"{han(5)}，{lines}{han(8)}", f"{han(40)}{plain}{han(40)}", f"{han(40)}{plain}{han(40)}"])
    spans = {r.doc_id: [s.end - s.start for s in r.removed_spans] for r in line_dedup.remove_repeated(docs).collect()}
    assert spans == {0: [], 1: [len(lines.encode())], 2: [], 3: [len(plain.encode())]}


def test_long_edges_go(documents):
    rng = random.Random(14)
    clauses = [f"{'x' * 300}{k} {'y' * 300}{rng.randrange(10**6)}." for k in range(2)]
    passage = " ".join([*clauses, words_of(rng, 10, "m") + ".", words_of(rng, 10, "n") + ".", *clauses[::-1]])
    gone = removed(documents([f"Begin here. {passage} End", f"Another start. {passage} Stop"]))
    assert gone[1].decode().strip() == passage


def test_boundaries_equal_all_stretches():
    rng = random.Random(2)
    for _ in range(300):
        first, last, low, high, word = [], [], [], [], 0
        for _ in range(rng.randrange(1, 4)):  # texts
            begin, at = word, word + rng.randrange(3)
            ends = begin
            for _ in range(rng.randrange(8)):
                ends = max(ends, at + rng.randrange(1, 15))
                first.append(at)
                last.append(ends)
                at += rng.randrange(1, 7)
            word = max(at, ends) + rng.randrange(3) + 1
            low += [begin] * (len(first) - len(low))
            high += [word] * (len(first) - len(high))
        hashes = [rng.randrange(1000) * 1000 + i for i in range(len(first))]
        for size in (9, 20):
            expected = set()
            for a, b in set(zip(low, high)):
                for p in range(a, max(a, b - size) + 1):
                    inside = [i for i in range(len(first)) if first[i] >= p and last[i] <= min(b, p + size)]
                    if inside:
                        expected.add(min(inside, key=hashes.__getitem__))
            got = line_dedup._boundaries(*(np.array(x, np.int64) for x in (hashes, first, last, low, high)), size)
            assert set(np.flatnonzero(got).tolist()) == expected


def test_fewer_than_half_of_all_runs_are_chunks(spark):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect() if r.text]
    n_chunks, n_lines = 0, 0
    for part in slices(pa.array(texts)):
        n_chunks, n_lines = n_chunks + len(line_dedup.chunks(part)[0]), n_lines + len(line_dedup.lines(part)[0])
    assert n_chunks < 0.5 * n_lines


def test_repeats_equal_all_pairs_of_lines(spark):
    """Every stretch of whole lines of the stated size that stands in an earlier document too is gone or stands there no more."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect() if r.text}
    gone = removed(docs)
    listed = {}
    for i, t in texts.items():
        starts, bodies, ends = (x.tolist() for x in line_dedup.lines(next(slices(pa.array([t])))))
        raw = t.encode()
        listed[i] = [raw[a:b] for a, b in zip(starts, bodies)], [raw[a:b] for a, b in zip(starts, ends)]
    ids, missed, there = sorted(listed), 0, 0
    for place, i in enumerate(ids):
        mine, whole = listed[i]
        for j in ids[:place]:
            other = listed[j][0]
            at = {}
            for k, line in enumerate(other):
                at.setdefault(line, []).append(k)
            k = 0
            while k < len(mine):
                best = 0
                for o in at.get(mine[k], ()):
                    n = 0
                    while k + n < len(mine) and o + n < len(other) and mine[k + n] == other[o + n]:
                        n += 1
                    best = max(best, n)
                if best >= 2 and sum(len(x.split()) for x in mine[k:k + best]) >= line_dedup.SURE + 15:
                    there += 1
                    missed += b"".join(whole[k:k + best]).strip() not in gone[i]
                k += max(best, 1)
    assert there > 0 and missed == 0
