from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from kartoteka.plans.load import Landing, any_details_from, full_load
from kartoteka.sources import landing as src
from kartoteka.sources.stored import read_table


def write(path, value, indent=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=indent))


def test_envelope_pretty_printed_and_per_line(spark, tmp_path):
    rows = [{"idCategory": "1", "strCategory": "Beef"}, {"idCategory": "2", "strCategory": "Side"}]
    write(tmp_path / "a.json", {"categories": rows}, indent=2)
    (tmp_path / "b.json").write_text("\n".join(json.dumps({"categories": v}) for v in ([rows[0]], None, [], [rows[1]])))
    pretty = src.read_envelope(spark, str(tmp_path / "a.json"), "categories", src.CATEGORY_FIELDS, multiline=True)
    lines = src.read_envelope(spark, str(tmp_path / "b.json"), "categories", src.CATEGORY_FIELDS)
    assert sorted(r.strCategory for r in pretty.collect()) == sorted(r.strCategory for r in lines.collect()) == ["Beef", "Side"]
    assert pretty.columns == src.CATEGORY_FIELDS.names


def test_a_response_that_is_not_json_stops_the_load(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"categories": [{"idCategory": "1"}]}\n\n{"categories": [{"idCat')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        src.read_envelope(spark, str(tmp_path / "a.json"), "categories", src.CATEGORY_FIELDS).collect()


def test_tagged_listings_take_the_folder_name(spark, tmp_path):
    write(tmp_path / "category=Side Dish" / "1.json", {"meals": [{"idMeal": "1"}, {"idMeal": "2"}]})
    write(tmp_path / "category=007" / "1.json", {"meals": [{"idMeal": "3"}]})
    write(tmp_path / "category=Goat" / "1.json", {"meals": None})
    got = src.read_tagged_listings(spark, str(tmp_path), "meals", src.LISTING_FIELDS)
    assert sorted((r.category_name, r.idMeal) for r in got.collect()) == [("007", "3"), ("Side Dish", "1"), ("Side Dish", "2")]


def test_places_from_a_pretty_array(spark, tmp_path):
    write(tmp_path / "iso.json", [
        {"name": {"common": "Peru", "official": "Republic of Peru"}, "cca2": "PE", "subregion": "South America", "area": 1.0},
        {"name": {"common": "Fiji"}, "cca2": "FJ"}], indent=1)
    got = src.read_places(spark, str(tmp_path / "iso.json"))
    assert sorted(tuple(r) for r in got.fillna("-").collect()) == [("Fiji", "FJ", "-"), ("Peru", "PE", "South America")]


def test_submissions_and_questions(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"name_meal": "Soup", "category": "Side", "unknown": 1}))
    (tmp_path / "q.json").write_text(json.dumps({"question_id": 7, "text": "what is pepper"}))
    submission = src.read_submissions(spark, str(tmp_path / "s.json")).first()
    assert (submission.name_meal, submission.country) == ("Soup", None)
    assert tuple(src.read_questions(spark, str(tmp_path / "q.json")).first()) == (7, "what is pepper")


def test_read_table(spark, tmp_path):
    spark.range(3).withColumn("x", F.lit("a")).write.parquet(str(tmp_path / "t"))
    assert read_table(spark, str(tmp_path / "t"), ["id"]).columns == ["id"]
    spark.range(2).createOrReplaceTempView("some_table")
    assert read_table(spark, "some_table", fmt="table").count() == 2


def meal(key, country, category="Beef", **more):
    return {"idMeal": key, "strMeal": f"Dish {key}", "strCategory": category, "strCountry": country, "strArea": country, **more}


def landed(tmp_path) -> Landing:
    write(tmp_path / "categories/1.json", {"categories": [
        {"idCategory": "1", "strCategory": "Beef", "strCategoryThumb": "http://beef"}, {"idCategory": "2", "strCategory": "Side"}]}, indent=1)
    write(tmp_path / "components/1.json", {"meals": [{"idIngredient": "9", "strIngredient": "Salt"}]})
    write(tmp_path / "listing/category=Beef/1.json", {"meals": [meal("10", "Turkey"), meal("11", "Nowhere")]})
    write(tmp_path / "listing/category=Side/1.json", {"meals": [meal("12", "Peru")]})
    write(tmp_path / "listing/category=Unknown/1.json", {"meals": [meal("13", "Peru")]})
    for key in ("10", "11", "12", "13"):
        write(tmp_path / f"detail/{key}.json", {"meals": [meal(
            key, "x", strInstructions="Cook.", strIngredient1=" Salt ", strMeasure1="1g", strIngredient2="", strIngredient3="lost",
            dateModified="2024-03-01")]}, indent=2)
    write(tmp_path / "detail/14.json", {"meals": None})
    write(tmp_path / "places/1.json", {"meals": [
        {"strArea": "Turkish", "strCountry": "Turkey"}, {"strArea": "Peruvian", "strCountry": "Peru"},
        {"strArea": "Lost", "strCountry": "Atlantis"}]})
    write(tmp_path / "iso/1.json", [
        {"name": {"common": "Türkiye"}, "cca2": "TR", "subregion": "Western Asia"},
        {"name": {"common": "Peru"}, "cca2": "PE", "subregion": "South America"}], indent=1)
    folder = lambda name: str(tmp_path / name)
    return Landing(folder("categories"), folder("components"), folder("listing"), folder("detail"), folder("places"),
                   folder("iso"), multiline=True)


def test_full_load(spark, tmp_path):
    tables = full_load(spark, landed(tmp_path), "api")
    items = {r.external_id_meal: r for r in tables["recipe"].collect()}
    assert sorted(items) == [10, 12]  # no place for 11, no category for 13
    category = {r.name: r for r in tables["category"].collect()}
    assert items[10].guid_category == category["Beef"].id_guid_sk and category["Beef"].imagem == "http://beef"
    assert json.loads(items[10].ingredient_measure) == {"1": {"ingredient": "Salt", "measure": "1g"}}
    assert items[10].region == "Western Asia" and items[12].region == "South America"
    place = {r.country: r for r in tables["country"].collect()}
    assert (place["Turkey"].acronym, place["Turkey"].image[-7:]) == ("TR", "/tr.png")
    assert (place["Atlantis"].acronym, place["Atlantis"].region, place["Atlantis"].image) == (None, None, None)
    assert {r["__source"] for r in tables["ingredients"].collect()} == {"api"}
    again = {r.external_id_meal: r.id_guid_sk for r in full_load(spark, landed(tmp_path), "api")["recipe"].collect()}
    assert again == {k: r.id_guid_sk for k, r in items.items()}


def test_details_of_any_shape(spark, tmp_path):
    meals = [{"idMeal": "1", "strMeal": "Stew", "strArea": "Peru", **{f"strIngredient{i}": f"c{i}" for i in range(1, 25)}, "strMeasure24": "2g", "rating": 4.5, "tags": ["a", "b"]},
             {"idMeal": "2", "strIngredient1": "x", "strIngredient2": " ", "strIngredient3": "lost", "strMeasure1": None}, {"idMeal": "3"}]
    write(tmp_path / "a.json", {"meals": meals}, indent=1)
    write(tmp_path / "b.json", {"meals": None})
    got = {r.external_id: r for r in any_details_from(src.read_any_details(spark, str(tmp_path), multiline=True), "api").collect()}
    assert sorted(got) == ["1", "2", "3"]
    assert sorted(got["1"].ingredient_measure, key=int) == [str(i) for i in range(1, 25)] and tuple(got["1"].ingredient_measure["24"]) == ("c24", "2g")
    assert got["1"].other_fields == {"strArea": "Peru", "rating": "4.5", "tags": '["a","b"]'}
    assert {k: tuple(v) for k, v in got["2"].ingredient_measure.items()} == {"1": ("x", "")} and got["3"].ingredient_measure == {} == got["3"].other_fields


def test_a_bad_submission_is_a_row(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"name_meal": "Soup", "category": "Side"}\n{"name_meal": "So')
    rows = src.read_submissions(spark, str(tmp_path / "s.json"), strict=False).collect()
    assert sorted((r.name_meal or "", r.unreadable or "") for r in rows) == [("", '{"name_meal": "So'), ("Soup", "")]
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        src.read_submissions(spark, str(tmp_path / "s.json")).collect()
