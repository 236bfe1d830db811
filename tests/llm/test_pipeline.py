from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kartoteka.operators.tables import staged_table
from kartoteka.registry.base import table
from test_near_dup import brute
from test_secrets import brute_base

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_another(spark):
    docs = table(spark, FOLDER, "documents")
    quality, lines, minhash, secrets, packing = (stage for _, stage in corpus_pipeline.STAGES)

    good = staged_table(quality(spark, docs, FOLDER), "good")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns and kept.items() < texts.items()
    assert all(len(re.findall("[^\x20\x09-\x0d]+", t)) >= 20 for t in kept.values())

    deduped = staged_table(lines(spark, good, FOLDER), "deduped")
    shorter = {r.doc_id: r.text for r in deduped.collect()}
    assert deduped.columns == docs.columns and shorter.keys() == kept.keys()
    assert any(len(shorter[i]) < len(kept[i]) for i in kept) and all(len(shorter[i]) <= len(kept[i]) for i in kept)

    single = staged_table(minhash(spark, deduped, FOLDER), "single")
    expected = {i for i, (_, component) in brute(deduped).items() if i == component}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == expected

    masked = staged_table(secrets(spark, single, FOLDER), "masked")
    after = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == docs.columns and after.keys() == expected
    for i in expected:
        assert not brute_base(after[i]) and (after[i] == shorter[i] or "[" in after[i])

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = Counter()
    for r in packing(spark, masked, FOLDER).collect():
        pieces[r.doc_id] += r.length
    assert pieces == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()}

    whole = Counter()
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        whole[r.doc_id] += r.length
    assert whole == pieces


def test_an_empty_table_goes_through(spark, documents):
    out = documents([])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, FOLDER)
    assert out.count() == 0
