from __future__ import annotations

import re
from collections import Counter

import pytest

from conftest_llm import EDGE_TEXTS
from kartoteka.llm import quality
from kartoteka.registry.base import table

FOLDER = "/root/testdata/sf0.001"


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines, seen, duplicates = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            duplicates += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), duplicates, len(covered))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def check(docs, labels):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    rows = quality.judge_quality(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, t in texts.items() for _ in t)
    for r in rows:
        counts = tuple(r[c] for c in COLUMNS)
        assert counts in [brute_counts(t) for t in texts[r.doc_id]], r.doc_id
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert r.base_failed == failed and not (failed and r.kept)
    return rows


def test_counts_match_brute_force(spark):
    rows = check(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    assert any(not r.kept for r in rows)


def test_edge_texts(spark, documents):
    labels = spark.createDataFrame([(0, None, 1), (None, 0, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    check(documents(EDGE_TEXTS + ["a b c d e f g h\na b c d e f g h\n\n\n", "one two " * 40]), labels)
    assert quality.judge_quality(documents([]), labels).count() == 0


def test_good_documents_stay_and_bad_ones_go(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality.judge_quality(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_rows_keep_their_columns(documents):
    docs = documents(["word " * 3, " ".join(f"w{i}" for i in range(40))])
    labels = docs.selectExpr("doc_id", "cast(null as int) as quality", "0 as toxic")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


@pytest.mark.parametrize("value", [0.1, 0.9])
def test_a_planted_threshold_is_found(value):
    import numpy as np
    x = np.random.default_rng(1).random((900, len(quality.RATIOS)))
    bad = x[:, 3] > value
    rules = quality.learn_rules(x, bad)
    covered = np.zeros(len(x), bool)
    for rule in rules:
        covered |= quality._covered(rule, x)
    assert (covered == bad).mean() > 0.98
