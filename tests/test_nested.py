from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kartoteka.functions.nested import (
    explode_components,
    map_to_list,
    pairs_to_map,
    to_json_text,
    wide_slots,
    wide_to_map,
)


def wide(spark, *slots):
    n = len(slots)
    schema = ", ".join([f"c{i} string" for i in range(1, n + 1)] + [f"m{i} string" for i in range(1, n + 1)])
    df = spark.createDataFrame([tuple(c for c, _ in slots) + tuple(m for _, m in slots)], schema)
    mapped = df.select(wide_to_map([f"c{i}" for i in range(1, n + 1)], [f"m{i}" for i in range(1, n + 1)])).first()[0]
    return {k: tuple(v) for k, v in mapped.items()}


def test_wide_to_map_stops_at_first_blank(spark):
    got = wide(spark, (" a ", "1 "), ("b", None), ("  ", "x"), ("d", "4"))
    assert got == {"1": ("a", "1"), "2": ("b", "")}


def test_wide_to_map_edges(spark):
    assert wide(spark, (None, "1"), ("b", "2")) == {}
    assert wide(spark, *[(f"c{i}", f"m{i}") for i in range(20)]) == {str(i + 1): (f"c{i}", f"m{i}") for i in range(20)}


def test_wide_slots_tolerates_missing_columns(spark):
    df = spark.createDataFrame([("a", "1", "b")], "strIngredient1 string, strMeasure1 string, strIngredient2 string")
    mapped = df.select(wide_slots(df, "strIngredient", "strMeasure")).first()[0]
    assert {k: tuple(v) for k, v in mapped.items()} == {"1": ("a", "1"), "2": ("b", "")}


def listed(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string").select("id", map_to_list("j").alias("l"))
    return [[tuple(e) for e in r["l"]] for r in df.orderBy("id").collect()]


def test_map_to_list_orders_by_number(spark):
    text = ('{"10":{"ingredient":"j","measure":"1"},"x":{"ingredient":"last","measure":"m"},'
            '"2":{"ingredient":" b ","measure":" 2 "},"3":{"ingredient":" ","measure":"0"}}')
    assert listed(spark, text) == [[("b", "2"), ("j", "1"), ("last", "m")]]


def test_map_to_list_unreadable_is_empty(spark):
    assert listed(spark, "not json", None, "", "{", "[]", "{}", '"text"', '{"1":{"ingredient":"a"}') == [[]] * 8


def test_map_to_list_arrays_pass_through(spark):
    text = '[{"ingredient":"q","measure":"9"},{"ingredient":""},"odd",{"ingredient":"r"}]'
    assert listed(spark, text) == [[("q", "9"), ("r", None)]]


def test_map_to_list_odd_values_do_not_void_the_rest(spark):
    text = '{"1":{"ingredient":"a","measure":5},"2":"odd","3":null,"4":{"measure":"x"},"5":{"ingredient":"e"}}'
    assert listed(spark, text) == [[("a", "5"), ("e", "")]]


def test_map_to_list_keys_beyond_999(spark):
    text = '{"1000":{"ingredient":"late"},"x":{"ingredient":"odd"},"99999999999999999999":{"ingredient":"huge"}}'
    assert listed(spark, text) == [[("late", ""), ("huge", ""), ("odd", "")]]


def paired(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(pairs_to_map("t")).first()[0]
    return {k: tuple(v) for k, v in got.items()}


def test_pairs_to_map(spark):
    assert paired(spark, "Cod - 500g; salt; Flour - 200g - fine;") == {"1": ("Cod", "500g"), "3": ("Flour", "200g - fine")}
    assert list(paired(spark, "Cod - 500g; Flour - 200g; Beer - 300ml; Potatoes - 1kg")) == ["1", "2", "3", "4"]
    assert paired(spark, "") == {} and paired(spark, None) == {} and paired(spark, " ; ;") == {}
    assert paired(spark, ";; a -  b ;") == {"1": ("a", "b")}


def test_explode_components(spark):
    df = spark.createDataFrame([(1, '{"2":{"ingredient":"b"},"1":{"ingredient":"a","measure":"1"}}'), (2, "bad")], "id int, j string")
    assert [tuple(r) for r in explode_components(df, "j", "id").orderBy("position").collect()] == [(1, 1, "a", "1"), (1, 2, "b", "")]


word = st.text(alphabet="abcé ü%", min_size=1, max_size=8).map(str.strip).filter(bool)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(word, word), max_size=12), min_size=1, max_size=20))
def test_typed_pairs_round_trip(spark, cases):
    typed = [(i, "; ".join(f"{c} - {m}" for c, m in case)) for i, case in enumerate(cases)]
    df = spark.createDataFrame(typed, "id int, t string")
    back = df.select("id", map_to_list(to_json_text(pairs_to_map("t"))).alias("l")).orderBy("id").collect()
    assert [[tuple(e) for e in r["l"]] for r in back] == cases


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(
    st.sampled_from(["1", "2", "10", "007", "x", "y", "1001"]),
    st.fixed_dictionaries({"ingredient": st.sampled_from(["a", " b ", "", "c"]), "measure": st.sampled_from(["", " 1 "])})),
    min_size=1, max_size=20))
def test_map_to_list_like_a_sorted_dictionary(spark, cases):
    """Brute force: numbers first, by value, then other keys; ties in written order."""
    expected = []
    for case in cases:
        keys = sorted(case, key=lambda k: (not k.isdigit(), int(k) if k.isdigit() else 0))
        expected.append([(case[k]["ingredient"].strip(), case[k]["measure"].strip()) for k in keys if case[k]["ingredient"].strip()])
    assert listed(spark, *[json.dumps(c) for c in cases]) == expected


@pytest.mark.parametrize("struct", ["a", "b"])
def test_to_json_text(spark, struct):
    df = spark.range(1).select(F.struct(F.lit(1).alias(struct)).alias("s"))
    assert df.select(to_json_text("s")).first()[0] == json.dumps({struct: 1}, separators=(",", ":"))
