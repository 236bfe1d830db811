"""The worked examples of a small catalogue, from landing to answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kartoteka.plans.catalogue import Catalogue
from kartoteka.plans.search import embed_new


@pytest.fixture(scope="module")
def catalogue(spark):
    categories = spark.createDataFrame([("c1", "Seafood", "sea.png"), ("c2", "Side", "side.png"), ("c3", "Goat", None)],
                                       "id_guid_sk string, name string, imagem string")
    places = spark.createDataFrame([("p1", "Brazil", "South America", "br.png"), ("p2", "England", "British", "gb.png")],
                                   "id_guid_sk string, country string, region string, image string")
    components = spark.createDataFrame([("k1", "Black Pepper", "ground"), ("k2", "Pepper", "pungent"), ("k3", "Thyme", None)],
                                       "id_guid_sk string, ingredient_name string, description string")
    cod = '{"2":{"ingredient":"Salt","measure":"1g"},"1":{"ingredient":"Cod ","measure":"500g"}}'
    items = spark.createDataFrame([
        ("g1", 1, "Fish and Chips", "c1", "England", "British", "Fry the cod 50%_ long", cod, "1.png", "v1", "s1", "2024-01-01"),
        ("g2", 2, "Feijoada", "c2", "Brazil", "South America", "Boil beans", None, "2.png", None, None, None),
        ("g3", None, "Bean Soup", "c2", "Brazil", "South America", "Boil beans and peppers", "bad", None, None, None, None),
        ("g4", 4, "Bean Soup", "c9", "Brazil", "South America", "Boil", None, "4.png", None, None, None),
        ("g5", 5, "Lost Soup", "c2", "Atlantis", None, "Boil cod", None, None, None, None, None)],
        "id_guid_sk string, external_id_meal int, name_meal string, guid_category string, country string, region string, "
        "instructions string, ingredient_measure string, image_recipe string, video_recipe string, source_url string, date_modified string")
    none = spark.createDataFrame([], "external_id_meal int, guid_recipe string, chunk_index int, chunk_text string, "
                                     "embedding array<float>, model_name string, created_at timestamp")
    return Catalogue(items, categories, places, components, embed_new(items, none, "words"))


def names(df):
    return [r.name for r in df.collect()]


def test_list(catalogue):
    listed = catalogue.list_items()
    assert listed.columns == ["id", "name", "category", "area", "thumbnail_url", "instructions", "youtube_url", "country_flag"]
    assert [(r.name, r.id, r.category) for r in listed.collect()] == [
        ("Bean Soup", None, "Side"), ("Bean Soup", 4, None), ("Feijoada", 2, "Side"), ("Fish and Chips", 1, "Seafood")]
    assert names(catalogue.list_items(limit=2, offset=1)) == ["Bean Soup", "Feijoada"]


def test_item(catalogue):
    found = catalogue.item(1).first()
    assert [tuple(i) for i in found.ingredients] == [("Cod", "500g"), ("Salt", "1g")] and found.source_url == "s1"
    assert catalogue.item(5).first().category == "Side"  # shown although its place is not on the list
    assert catalogue.item(99).count() == 0


def test_by_category_and_place(catalogue):
    found = catalogue.by_category("sIdE").collect()
    assert [(r.name, r.category_image, r.country_flag, len(r.ingredients)) for r in found] == [
        ("Bean Soup", "side.png", "br.png", 0), ("Feijoada", "side.png", "br.png", 0)]
    assert names(catalogue.by_place("BRAZIL", limit=2)) == ["Bean Soup", "Bean Soup"]


def test_search(catalogue):
    assert names(catalogue.search(" COD ")) == ["Fish and Chips", "Lost Soup"]
    assert names(catalogue.search("50%_")) == ["Fish and Chips"]
    assert names(catalogue.search("salt")) == ["Fish and Chips"]


def test_names_facets_and_stats(catalogue):
    assert names(catalogue.category_names()) == ["Goat", "Seafood", "Side"]
    assert names(catalogue.place_names()) == ["Brazil", "England"]
    assert [tuple(r) for r in catalogue.facets().collect()] == [("Goat", 0), ("Seafood", 1), ("Side", 3)]
    assert {r.table_name: r.n for r in catalogue.stats().collect()} == {
        "total_recipes": 5, "total_categories": 3, "total_countries": 2}


def test_answer(spark, catalogue):
    questions = spark.createDataFrame([(1, "what is pepper"), (2, "give me brazilian recipes"), (3, "bean soup"), (4, "xyz")],
                                      "question_id int, text string")
    got = catalogue.answer(questions).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.type, r["rank"], r.hit_key) for r in got] == [
        (1, "component_info", 1, "k1"),
        (2, "item_list", 1, "g3"), (2, "item_list", 2, "g4"), (2, "item_list", 3, "g2"),
        (3, "item_list", 1, "g3"), (3, "item_list", 2, "g4"), (4, "no_results", None, None)]


def test_chat(spark, catalogue):
    questions = spark.createDataFrame([(1, "boil beans"), (2, "Add a dish"), (3, " "), (4, "?!")], "question_id int, text string")
    got = catalogue.chat(questions, k=2).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.type, r["rank"]) for r in got] == [
        (1, "recipe_search", 1), (1, "recipe_search", 2), (2, "template", None), (3, "empty_query", None), (4, "no_results", None)]
    assert {r.name_meal for r in got[:2]} == {"Feijoada", "Bean Soup"} and got[0].category_name == "Side"


def test_submit(spark, catalogue):
    given = spark.createDataFrame(
        [("Fish and Chips", "Seafood", "england", "Coat fish.", "Cod - 500g; Flour - 200g", "", "", ""), ("", "Seafood", "England", "", "", "", "", "")],
        "name_meal string, category string, country string, instructions string, ingredient_measure string, "
        "image_recipe string, video_recipe string, source_url string")
    items, rejected = catalogue.submit(given)
    added = items.first()
    assert (added.guid_category, added.country, added.region) == ("c1", "England", "British")
    assert [r.reason for r in rejected.collect()] == ["name is required"]
    both = catalogue.items.unionByName(items)
    assert both.where(F.col("external_id_meal").isNull()).count() == 2
