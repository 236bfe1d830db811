from __future__ import annotations

import json
from datetime import datetime

from kartoteka.operators.validate import check_submissions, place_hints, to_items, validate_submissions
from kartoteka.sources.landing import SUBMISSION_FIELDS


def submissions(spark, *given):
    rows = [tuple({"name_meal": "Soup", "category": "side", "country": "itALY", "instructions": " Boil ",
                   "ingredient_measure": "Cod - 500g; salt; Flour - 200g - fine;", "image_recipe": "", "video_recipe": None,
                   "source_url": f"http://{i}", **g}[n] for n in SUBMISSION_FIELDS.names) for i, g in enumerate(given)]
    return spark.createDataFrame(rows, SUBMISSION_FIELDS)


def dims(spark):
    categories = spark.createDataFrame([("g1", "Side"), ("g2", "Beef")], "id_guid_sk string, name string")
    names = ["Italy"] + [f"P{i:02d}" for i in range(25)]
    places = spark.createDataFrame([(n, "Europe") for n in names] + [("P00", "Europe"), (None, "?")], "country string, region string")
    return categories, places


CASES = [
    ({}, None),
    ({"category": " ", "country": "nowhere"}, "category is required"),
    ({"category": None}, "category is required"),
    ({"category": "x", "country": ""}, "category not found"),
    ({"country": "\t"}, "country is required"),
    ({"country": "nowhere", "name_meal": ""}, "country not found"),
    ({"name_meal": "  "}, "name is required"),
    ({"category": " BEEF "}, None),
]


def test_first_failure_is_the_reason(spark):
    checked = check_submissions(submissions(spark, *[c for c, _ in CASES]), *dims(spark)).orderBy("source_url").collect()
    assert [r.reason for r in checked] == [reason for _, reason in CASES]


def test_accepted_and_rejected_make_the_whole(spark):
    accepted, rejected = validate_submissions(submissions(spark, *[c for c, _ in CASES]), *dims(spark))
    assert accepted.count() + rejected.count() == len(CASES)
    first = accepted.orderBy("source_url").first()
    assert (first.country, first.region, first.guid_category) == ("Italy", "Europe", "g1")
    hints = {r.reason: r.hint for r in rejected.collect()}
    assert hints["country not found"] == "Try one of: Italy, P00, P01, P02, P03, P04, P05, P06, P07, P08"
    assert hints["name is required"] is None


def test_place_hints(spark):
    hint = place_hints(dims(spark)[1]).first()
    assert len(hint.available_places) == 20 and hint.available_places[:2] == ["Italy", "P00"]


def test_to_items(spark):
    accepted, _ = validate_submissions(submissions(spark, {}, {}), *dims(spark))
    first, second = to_items(accepted, as_of=datetime(2024, 1, 2)).collect()
    assert first.id_guid_sk != second.id_guid_sk and first.external_id_meal is None
    assert json.loads(first.ingredient_measure) == {
        "1": {"ingredient": "Cod", "measure": "500g"}, "3": {"ingredient": "Flour", "measure": "200g - fine"}}
    assert (first.instructions, first.date_modified) == ("Boil", "2024-01-02 00:00:00")
