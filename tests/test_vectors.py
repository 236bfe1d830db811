from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kartoteka.functions.vectors import cosine, cosine_distance, norm
from kartoteka.operators.embedding import WordHashing, compose_text, embed
from kartoteka.operators.similarity import Cells, ann_topk, cosine_topk, cosine_topk_among
from kartoteka.plans.search import embed_new, nearest_chunks, semantic_search


def table(spark, vectors, chunks=1):
    data = [(i // chunks, i % chunks, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, "item int, chunk int, embedding array<float>").repartition(5)


def asked(spark, vectors):
    return spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 "query_id string, embedding array<float>")


def brute_force(vectors, queries, k, chunks=1):
    """All pairs in numpy: best chunk per item, then the k best items; ties go to lower numbers."""
    out = []
    v, q = np.asarray(vectors, np.float32).astype(float), np.asarray(queries, np.float32).astype(float)
    for n, query in enumerate(q):
        with np.errstate(invalid="ignore", divide="ignore"):
            sims = np.round(v @ query / (np.linalg.norm(v, axis=1) * np.linalg.norm(query)), 9)
        best = {}
        for i, s in enumerate(sims):
            if not np.isnan(s) and (i // chunks not in best or s > best[i // chunks][0]):
                best[i // chunks] = (s, i % chunks)
        ranked = sorted(best.items(), key=lambda e: (-e[1][0], e[0]))[:k]
        out += [(f"q{n}", r + 1, item, chunk, round(float(s), 6)) for r, (item, (s, chunk)) in enumerate(ranked)]
    return out


def result(df):
    return sorted((r.query_id, r["rank"], r.item, r.chunk, round(r.similarity, 6)) for r in df.collect())


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-3.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [4.0, 3.0])],
                               "a array<float>, b array<float>")
    got = df.select(cosine("a", "b"), cosine_distance("a", "b"), norm("a")).collect()
    assert [tuple(r) for r in got[:3]] == [(1.0, 0.0, 1.0), (-1.0, 2.0, 1.0), (None, None, 0.0)]
    assert got[3][0] == pytest.approx(0.96) and got[3][2] == 5.0


@pytest.mark.parametrize("chunks", [1, 4])
@pytest.mark.parametrize("limits", [{}, {"max_probes": 3}, {"max_bytes": 200}])
def test_cosine_topk_equals_brute_force(spark, chunks, limits):
    rng = np.random.default_rng(chunks)
    vectors = rng.integers(-2, 3, (240, 6))  # small whole numbers: many ties, some zero vectors
    vectors[7] = 0
    queries = rng.integers(-2, 3, (9, 6))
    queries[4] = 0
    got = cosine_topk(table(spark, vectors, chunks), asked(spark, queries), 6, item="item", chunk="chunk", **limits)
    assert result(got) == sorted(brute_force(vectors, queries, 6, chunks))


@pytest.mark.parametrize("share", [2, 40])
def test_topk_among_equals_brute_force(spark, share):
    """With every second item allowed the longer list does; with every fortieth, queries are asked again."""
    rng = np.random.default_rng(share)
    vectors, queries = rng.integers(-2, 3, (400, 6)), rng.normal(size=(7, 6))
    corpus = table(spark, vectors, 2)
    allowed = spark.range(0, 400, share).select(F.col("id").cast("int").alias("item"))
    got = cosine_topk_among(corpus, asked(spark, queries), 4, allowed, item="item", chunk="chunk")
    masked = [v if (i // 2) % share == 0 else [0] * 6 for i, v in enumerate(vectors)]
    assert result(got) == sorted(brute_force(masked, queries, 4, 2))


def test_one_item_with_most_chunks_takes_one_place(spark):
    rng = np.random.default_rng(3)
    close, other = rng.normal(size=8), rng.normal(size=(30, 8))
    data = [(0, c, [float(x) for x in close + 0.001 * c]) for c in range(500)] + [
        (i + 1, 0, [float(x) for x in v]) for i, v in enumerate(other)]
    df = spark.createDataFrame(data, "item int, chunk int, embedding array<float>").repartition(4)
    got = cosine_topk(df, asked(spark, [close]), 3, item="item", chunk="chunk").orderBy("rank").collect()
    assert [r.item for r in got][0] == 0 and len({r.item for r in got}) == 3
    assert [r.similarity for r in got] == sorted((r.similarity for r in got), reverse=True)


def test_text_keys_and_edges(spark):
    corpus = spark.createDataFrame([("b", [1.0, 1.0]), ("a", [2.0, 2.0]), ("z", [0.0, 0.0]), ("n", None), ("o", [-1.0, -1.0])],
                                   "item string, embedding array<float>")
    got = cosine_topk(corpus, asked(spark, [[1, 1]]), 5, item="item").orderBy("rank").collect()
    assert [(r.item, round(r.similarity, 9)) for r in got] == [("a", 1.0), ("b", 1.0), ("o", -1.0)]
    assert cosine_topk(corpus, asked(spark, [[1, 1]]).limit(0), 5, item="item").count() == 0
    assert cosine_topk(corpus.limit(0), asked(spark, [[1, 1]]), 5, item="item").count() == 0


def test_ann(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12))
    vectors = np.concatenate([c + 0.2 * rng.normal(size=(60, 12)) for c in centres])
    corpus, queries = table(spark, vectors), asked(spark, centres + 0.1 * rng.normal(size=(8, 12)))
    cells = Cells.fit(corpus, lists=8)
    celled = cells.assign(corpus)
    exact = result(cosine_topk(corpus, queries, 10, item="item"))
    assert result(ann_topk(celled, queries, cells, 10, probe=8, item="item")) == exact
    near = result(ann_topk(celled, queries, cells, 10, probe=2, item="item"))
    recall = len({(q, i) for q, _, i, _, _ in near} & {(q, i) for q, _, i, _, _ in exact}) / len(exact)
    assert recall > 0.9
    in_blocks = ann_topk(celled, queries, cells, 10, probe=2, item="item", max_probes=3)
    assert result(in_blocks) == near


def test_ann_reads_only_visited_folders(spark, tmp_path):
    rng = np.random.default_rng(6)
    corpus = table(spark, rng.normal(size=(200, 4)))
    cells = Cells.fit(corpus, lists=10)
    cells.assign(corpus).write.partitionBy("cell").parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    queries = asked(spark, rng.normal(size=(1, 4)))
    got = ann_topk(stored, queries, cells, 3, probe=1, item="item")
    cell = cells.nearest(queries, "embedding", "c").first()["c"][0]
    inside = {r.item for r in stored.where(F.col("cell") == cell).collect()}
    assert 0 < got.count() <= 3 and {r.item for r in got.collect()} <= inside


def test_compose_text(spark):
    df = spark.createDataFrame(
        [("Soup", "Peru", "South", "Boil.", "x" * 1300), (None, None, "South", " \n", " "), ("Soup", "Peru", None, None, None)],
        "n string, c string, r string, i string, m string")
    one, two, three = [r[0] for r in df.select(compose_text("n", "c", "r", "i", "m")).collect()]
    start = "Recipe: Soup | Country: Peru (South) | Instructions: Boil. | Ingredients: "
    assert one == start + "x" * 1300
    assert df.select(compose_text("n", "c", "r", "i", "m", component_limit=1200)).first()[0] == start + "x" * 1200
    assert two == "" and three == "Recipe: Soup | Country: Peru"


def test_embed_counts_words(spark):
    df = spark.createDataFrame([(1, "Red red_hot, Über über!"), (2, None), (3, "?!")], "id int, t string")
    vectors = {r.id: r.embedding for r in embed(df, "t", lambda: WordHashing(16)).collect()}
    assert sum(vectors[1]) == 5 and sorted(vectors[1])[-2:] == [2.0, 2.0]
    assert vectors[2] == vectors[3] == [0.0] * 16


def test_embed_takes_other_encoders(spark):
    class Length:
        def encode(self, texts):
            assert len(texts) <= 2
            return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("a" * i,) for i in range(7)], "t string")
    assert sorted(r.embedding[0] for r in embed(df, "t", Length, batch_size=2).collect()) == list(range(7))


NO_VECTORS = ("external_id_meal int, guid_recipe string, chunk_index int, chunk_text string, embedding array<float>, "
              "model_name string, created_at timestamp")


def catalogue(spark):
    items = spark.createDataFrame([
        (1, "g1", "Red soup", "Peru", "South", "boil red beans", None, "c1"),
        (2, "g2", "Red stew", "Nowhere", None, "boil red beans", None, "c1"),
        (None, "g3", "Red pie", "Peru", None, "bake red beans", '{"1":{"ingredient":"bean","measure":"1"}}', "c1"),
        (4, "g4", "Cake", "Peru", None, "bake sugar", None, "c9"),
        (5, "g5", "Tea", "Peru", None, "steep leaves", None, "c1")],
        "external_id_meal int, id_guid_sk string, name_meal string, country string, region string, instructions string, "
        "ingredient_measure string, guid_category string")
    places = spark.createDataFrame([("Peru", "a", "flag"), ("Peru", "b", "flag")], "country string, cuisine string, image string")
    categories = spark.createDataFrame([("c1", "Main", "img")], "id_guid_sk string, name string, imagem string")
    return items, places, categories


def test_embed_new_only_embeds_what_is_missing(spark):
    items, _, _ = catalogue(spark)
    none = spark.createDataFrame([], NO_VECTORS)
    first = embed_new(items.where("id_guid_sk < 'g3'"), none, "m")
    assert first.columns == none.columns and first.count() == 2
    second = embed_new(items.unionByName(items), first, "m")
    assert sorted(r.guid_recipe for r in second.collect()) == ["g3", "g4", "g5"]
    assert embed_new(items, first.unionByName(second), "m").count() == 0


def test_nearest_chunks_need_an_external_id(spark):
    items, _, _ = catalogue(spark)
    vectors = embed_new(items, spark.createDataFrame([], NO_VECTORS), "m")
    questions = spark.createDataFrame([(1, "red beans")], "question_id int, text string")
    got = nearest_chunks(questions, vectors, items, 2).orderBy("rank").collect()
    assert [(r.name_meal, r.region) for r in got] == [("Red stew", None), ("Red soup", "South")]
    assert got[0].chunk_text == "Recipe: Red stew | Country: Nowhere | Instructions: boil red beans"


def test_semantic_search_gives_no_slot_to_incomplete_items(spark):
    items, places, categories = catalogue(spark)
    vectors = embed_new(items, spark.createDataFrame([], NO_VECTORS), "m")
    questions = spark.createDataFrame([(1, "red beans"), (2, "?")], "question_id int, text string")
    found = semantic_search(
        questions, vectors, items, places, categories, 2,
        columns={"name_meal": "i.name_meal", "category_name": "c.name", "flag": "p.image", "ingredient_measure": "i.ingredient_measure"})
    got = [(r.question_id, r["rank"], r.name_meal, r.category_name, len(r.components)) for r in found.orderBy("rank").collect()]
    assert sorted(n for _, _, n, _, _ in got) == ["Red pie", "Red soup"]
    assert [(q, r, c) for q, r, _, c, _ in got] == [(1, 1, "Main"), (1, 2, "Main")]
    assert {n: k for _, _, n, _, k in got}["Red pie"] == 1


def test_words_counted_a_few_at_a_time(spark, monkeypatch):
    from kartoteka.operators import embedding

    df = spark.createDataFrame([(0, "a b a c"), (1, ""), (2, None), (3, "a " * 50), (4, "b c"), (5, "")], "id int, t string").coalesce(1)
    whole = [tuple(r.embedding) for r in embedding.embed(df, "t").orderBy("id").collect()]
    monkeypatch.setattr(embedding, "WORDS_AT_ONCE", 3)
    encoder = embedding.WordHashing()
    expected = [tuple(v.tolist()) for v in encoder.encode(["a b a c", "", "", "a " * 50, "b c", ""])]
    assert [tuple(r.embedding) for r in embedding.embed(df, "t").orderBy("id").collect()] == whole == expected
