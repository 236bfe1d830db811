from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest_llm import EDGE_TEXTS
from kartoteka.llm import toxicity
from kartoteka.llm.queries import op1_toxicity
from kartoteka.llm.spans import slices
from kartoteka.registry.base import table


def test_blocks_give_the_exact_nearest():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(500):
        terms = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.integers(1, 4, len(terms)).astype(float)
        vectors.append((terms, w / np.linalg.norm(w)))
    vectors += vectors[:100]  # ties
    dense = np.zeros((len(vectors), 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, 40, block=16)
    for q in range(0, 600, 7):
        cosines = np.round(dense @ dense[q], 12)
        expected = [i for i in np.lexsort((np.arange(600), -cosines)) if cosines[i] > 0 and i != q][:15]
        near, scores = index.nearest(*vectors[q], 15, skip=q)
        assert near.tolist() == expected and np.allclose(scores, cosines[expected])


def test_blocks_hold_examples_of_like_words_and_cosines_do_not_depend_on_companions():
    rng = np.random.default_rng(6)
    vectors = []
    for i in range(600):  # two vocabularies in turn, with a few terms of both
        terms = np.unique(np.concatenate([rng.choice(40, 12, replace=False) + 40 * (i % 2), rng.choice(400, 3) + 80]))
        w = rng.random(len(terms)) + 0.1
        vectors.append((terms, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(vectors, 480, block=250)
    blocks = [index.order[a:b] for a, b in zip(index.cuts[:-1], index.cuts[1:])]
    assert sorted(np.concatenate(blocks).tolist()) == list(range(600)) and max(map(len, blocks)) <= 250
    assert all(len(set((b % 2).tolist())) == 1 for b in blocks)  # so that texts multiply terms of their own words only
    dense = np.zeros((600, 480))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    together = index.nearest_of(vectors, 15, list(range(600)))
    for i, (near, cosines) in enumerate(together):
        expected = dense @ dense[i]
        assert len(near) == 15 and i not in near and np.abs(cosines - expected[near]).max() < 2e-12  # double precision
        assert np.sort(np.delete(expected, i))[-15] <= cosines[-1] + 2e-12
    for i in range(0, 600, 37):
        near, cosines = index.nearest(*vectors[i], 15, skip=i)
        assert near.tolist() == together[i][0].tolist() and cosines.tolist() == together[i][1].tolist()


def test_texts_are_put_together_in_portions(monkeypatch):
    from kartoteka.llm.letters import letter_tables

    monkeypatch.setattr(toxicity, "PORTION", 3)
    monkeypatch.setattr(toxicity, "PORTION_TERMS", 10)
    monkeypatch.setattr("kartoteka.llm.toxicity.slices", lambda column: slices(column, 30))
    texts = ["some words", None, "", "12 34", "words words again and again"] * 3 + ["last"]
    portions = list(toxicity._portions(pa.array(texts, pa.string()), {"letters": letter_tables(), "terms": np.zeros(0, np.uint64)}))
    assert len(portions) > 2 and [first for first, _, _ in portions] == np.cumsum([0, *(len(asked) for _, asked, _ in portions)])[:-1].tolist()
    assert [x for _, _, any_term in portions for x in any_term] == [bool(t) and t != "12 34" for t in texts]
    assert list(toxicity._portions(pa.array([], pa.string()), {"letters": letter_tables(), "terms": np.zeros(0, np.uint64)})) == []


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, 300) / 20
    y = (rng.random(300) < x).astype(float)
    xs, ys = toxicity.isotonic(x, y)
    assert (np.diff(ys) >= 0).all() and np.isclose(np.interp(x, xs, ys).mean(), y.mean())


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = op1_toxicity(spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert len(toxic) > 20 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_edge_texts(spark, documents):
    taught = [(100 + i, ("vile scoundrel " if i % 4 == 0 else "") + f"some words here {i}") for i in range(60)]
    docs = documents([*EDGE_TEXTS, *taught, (None, "vile scoundrel"), (7, "again")])
    labels = spark.createDataFrame([(100 + i, None, int(i % 4 == 0), "x") for i in range(60)] + [(None, 1, 1, ""), (0, 1, None, ""), (1, 1, 5, "")],
                                   "doc_id long, quality int, toxic int, text string")
    rows = toxicity.score_toxicity(docs, labels, F.lit(True)).collect()
    assert len(rows) == docs.count()
    assert all(r.predicted == 1 for r in rows if r.doc_id is None or r.doc_id >= 100 and r.doc_id % 4 == 0)
    assert all(r.predicted == 0 for r in rows if r.doc_id is not None and (r.doc_id < 100 or r.doc_id % 4))
    assert toxicity.score_toxicity(docs.limit(0), labels, F.lit(True)).count() == 0
    nothing = toxicity.score_toxicity(docs, labels.limit(0), F.lit(True)).collect()
    assert len(nothing) == docs.count() and {r.score for r in nothing} == {0.0}


def test_rare_terms_of_examples_count(spark, documents):
    # every toxic text has a word that only three examples have, and none that all of them share
    taught = [(i, f"{'abcdefghijklmnopqrst'[i // 4 % 20] * 7} plain talk of things" if i % 4 == 0 else f"calm {'uvwxyz'[i % 6] * 7} talk of things") for i in range(240)]
    asked = [(1000 + k, f"{'abcdefghijklmnopqrst'[k] * 7} plain") for k in range(20)] + [(2000 + k, f"calm {'uvwxyz'[k] * 7}") for k in range(6)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in taught], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(documents(taught + asked), labels, F.lit(True)).collect()}
    assert all(rows[i].predicted == (i < 2000) for i, _ in asked)
    by_id = dict(taught)
    assert all(by_id[e].split()[0] == text.split()[0] for i, text in asked for e in rows[i].evidence if i < 2000)
    assert all(len(rows[i].evidence) == 3 for i, _ in asked)  # clean texts have neighbours, too


def test_no_term_of_the_examples_is_left_out(spark, documents):
    docs = documents([(i, f"{'abcdefghij'[i % 10] * 3} word{'klmnopqrst'[i // 10] * 4}") for i in range(100)])
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(100)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, labels, F.lit(True)).collect()
    assert all(len(r.evidence) == 3 and r.doc_id in r.evidence for r in rows)
