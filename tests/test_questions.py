from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kartoteka.operators.matching import containing, first_contained, first_containing, gram_counts, grams
from kartoteka.operators.routing import (
    classify_chat,
    classify_questions,
    detect_place,
    item_template,
    route_questions,
)


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id int, text string")


@pytest.mark.parametrize("text, route, subject", [
    ("what is pepper", "component_info", "pepper"),
    ("What is the ingredient thyme", "component_info", "thyme"),
    ("what is leather", "component_info", "leather"),
    ("tell me about what is the salt", "component_info", "salt"),
    ("please describe  the red ingredient pepper ", "component_info", "red pepper"),
    ("give me Brazilian recipes", "place", "Brazil"),
    ("food from usa or italy", "place", "Italy"),
    ("chicken soup", "name", "chicken soup"),
    ("  Chicken SOUP ", "name", "chicken soup"),
    (" \t ", "empty_query", None),
    (None, "empty_query", None),
])
def test_classify_questions(spark, text, route, subject):
    got = classify_questions(questions(spark, text), "question_id", "text").first()
    assert (got.route, got.subject) == (route, subject)


def test_classify_chat(spark):
    texts = ["haddock", "add a recipe", "quero criar algo", "uma nova receita", "renew recipes", " ", None]
    got = questions(spark, *texts).select("question_id", classify_chat("text").alias("r")).orderBy("question_id").collect()
    assert [r.r for r in got] == ["item_search", "template", "template", "template", "item_search", "empty_query", "empty_query"]
    assert "name_meal" in item_template()


def test_detect_place_takes_the_lowest_rank(spark):
    aliases = spark.createDataFrame([(2, "Nation_1", "One"), (1, "nation_12", "Twelve"), (3, "nation_2", "Two"), (0, "", "All")],
                                    "rank int, alias string, place string")
    df = questions(spark, "in NATION_12 or nation_2", "nation_11", "nation_3", None, "")
    expected = ["Twelve", "One", None, None, None]
    for limits in ({}, {"max_listed": 0}):
        got = detect_place(df, "question_id", "text", aliases, **limits).orderBy("question_id").collect()
        assert [r.place for r in got] == expected


def catalogue(spark):
    items = spark.createDataFrame(
        [(1, "Chicken Soup", "Brazil"), (2, "Fish Soup", "Brazil"), (3, "Chicken Pie", "Italy"), (4, None, "Brazil"), (5, "Soup", None)],
        "id int, name string, area string")
    components = spark.createDataFrame([(1, "White Pepper", "mild"), (2, "Pepper", "hot"), (3, "Thyme", None)],
                                       "key int, label string, text string")
    return items, components


def answers(spark, *texts, **limits):
    items, components = catalogue(spark)
    got = route_questions(
        questions(spark, *texts), "question_id", "text", items=items, item_key="id", item_name="name", item_place="area",
        components=components, component_key="key", component_name="label", description="text", **limits)
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[3] or 0))


@pytest.mark.parametrize("limits", [{}, {"max_listed": 0}])
def test_route_questions(spark, limits):
    got = answers(spark, "what is pepper", "give me brazilian recipes", "soup", "greek food", "what is unknownium", "nothing", " ", **limits)
    assert got == [
        (0, "component_info", "pepper", 1, "2", "Pepper", "hot"),
        (1, "item_list", "Brazil", 1, "1", "Chicken Soup", "Brazil"),
        (1, "item_list", "Brazil", 2, "2", "Fish Soup", "Brazil"),
        (1, "item_list", "Brazil", 3, "4", None, "Brazil"),
        (2, "item_list", "soup", 1, "1", "Chicken Soup", "Brazil"),
        (2, "item_list", "soup", 2, "2", "Fish Soup", "Brazil"),
        (2, "item_list", "soup", 3, "5", "Soup", None),
        (3, "no_results", "Greece", None, None, None, None),
        (4, "no_results", "unknownium", None, None, None, None),
        (5, "no_results", "nothing", None, None, None, None),
        (6, "empty_query", None, None, None, None, None),
    ]


def test_items_bring_their_card(spark):
    items, components = catalogue(spark)
    items = items.withColumns({"category": F.upper("name"), "flag": F.lit("http://flag")})
    got = route_questions(questions(spark, "soup", "what is pepper", "greek food"), "question_id", "text", items=items, item_key="id", item_name="name",
                          item_place="area", components=components, component_key="key", component_name="label", description="text", card=["category", "flag"])
    assert sorted({(r.type, r.hit_name, r.category, r.flag) for r in got.collect()}, key=str) == sorted([
        ("item_list", "Chicken Soup", "CHICKEN SOUP", "http://flag"), ("item_list", "Fish Soup", "FISH SOUP", "http://flag"), ("item_list", "Soup", "SOUP", "http://flag"),
        ("component_info", "Pepper", None, None), ("no_results", None, None, None)], key=str)


def test_info_without_a_name_takes_the_first_component(spark):
    assert answers(spark, "what is the")[0][4:6] == ("2", "Pepper")


@pytest.mark.parametrize("stored", [False, True])
def test_first_containing_equals_brute_force(spark, stored):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abAé ") for _ in range(n))
    # a third of all texts are the same
    texts = [(i, "ab ab" if i % 3 == 0 else word(rng.randint(0, 9))) for i in range(300)] + [(300, None)]
    terms = [word(rng.randint(1, 4)) for _ in range(30)] + ["ab", "ab", "", "x", "a" * 50]
    data = spark.createDataFrame(texts, "id int, t string").repartition(5)
    sought = spark.createDataFrame([(t,) for t in terms] + [(None,)], "term string")
    got = first_containing(data, "t", sought, "term", 4, order=["t", "id"], counts=gram_counts(data, "t") if stored else None)
    expected = []
    for term in {t.lower() for t in terms}:
        hits = sorted((t, i) for i, t in texts if t is not None and term in t.lower())[:4]
        expected += [(term, n + 1, t, i) for n, (t, i) in enumerate(hits)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("text, size, expected", [
    ("abcab", 3, ["abc", "bca", "cab"]), ("aaaa", 3, ["aaa"]), ("ab", 3, []), ("", 3, []), ("", 1, []), ("aé😀", 1, ["a", "é", "😀"]),
    ("aé😀", 2, ["aé", "é😀"]), ("aé😀", 3, ["aé😀"]), ("x", 0, [""]), ("a\nb", 3, ["a\nb"])])
def test_grams(spark, text, size, expected):
    assert sorted(spark.createDataFrame([(text,)], "t string").select(grams("t", size)).first()[0]) == sorted(expected)


def test_twenty_thousand_terms_take_no_more_scans(spark, tmp_path):
    texts = spark.range(3000).select("id", F.concat(F.lit("item "), F.hex(F.xxhash64("id"))).alias("t"))
    texts.write.parquet(str(tmp_path / "t"))
    data = spark.read.parquet(str(tmp_path / "t"))
    terms = spark.range(20_000).select(F.substring(F.hex(F.xxhash64("id")), 3, 7).alias("term"))
    found = containing(data, "t", terms, "term")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [id") == 1 and "Python" not in plan and "MapInArrow" not in plan
    sought = {r.term.lower() for r in terms.collect()}
    expected = sorted((r.id, r.t.lower()[i:i + 7]) for r in data.collect() for i in range(len(r.t)) if r.t.lower()[i:i + 7] in sought)
    assert sorted((r.id, r.term) for r in found.collect()) == sorted(set(expected)) and len(expected) >= 3000


def test_first_contained_keeps_every_row(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id") % 7).alias("t"))
    terms = spark.createDataFrame([("t3", 5, "three"), ("t", 9, "any"), ("t4", 1, "four")], "term string, r int, v string")
    for limits in ({}, {"max_listed": 0}):
        got = first_contained(df, "k", "t", terms, "term", "r", "v", "out", **limits).groupBy("t", "out").count()
        assert {(r.t, r.out) for r in got.collect()} == {
            ("t0", "any"), ("t1", "any"), ("t2", "any"), ("t3", "three"), ("t4", "four"), ("t5", "any"), ("t6", "any")}
        assert sum(r["count"] for r in got.collect()) == 1000


def test_grams_are_cut_in_compiled_code(spark, tmp_path):
    """Lambdas over arrays are interpreted, and keep what reads them out of the compiled stage."""
    spark.range(50).select("id", F.concat(F.lit("Item "), "id").alias("t")).write.parquet(str(tmp_path / "t"))
    data = spark.read.parquet(str(tmp_path / "t"))
    terms = spark.createDataFrame([("item 4",), ("em 7",)], "term string")
    found = containing(data, "t", terms, "term")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Contains(lower(" not in plan
    assert sorted((r.id, r.term) for r in found.collect()) == sorted([(i, "item 4") for i in (4, *range(40, 50))] + [(7, "em 7")])


def test_grams_of_long_texts_with_line_ends_and_rare_signs(spark):
    text = "".join(chr(0x61 + i % 26) + ("\n" if i % 7 == 0 else "😀" if i % 11 == 0 else "") for i in range(5_000))
    got = spark.createDataFrame([(text,)], "t string").select(grams("t")).first()[0]
    assert sorted(got) == sorted({text[i:i + 3] for i in range(len(text) - 2)})
