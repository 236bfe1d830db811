from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from kartoteka.functions import text as tx


def value(spark, column, **inputs):
    """The column's value on one row with these text inputs."""
    names = list(inputs) or ["none"]
    row = tuple(inputs[n] for n in inputs) or ("",)
    df = spark.createDataFrame([row], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("out")).first()["out"]


def test_strip_takes_all_white_space(spark):
    text = "\t\n\x0b\f\r\x1c\x85\xa0 　 a b  \n"
    assert value(spark, tx.strip("c"), c=text) == "a b" == text.strip()


@pytest.mark.parametrize("text, blank", [(None, True), ("", True), (" \t\n\xa0", True), (" a ", False)])
def test_is_blank(spark, text, blank):
    assert value(spark, tx.is_blank("c"), c=text) is blank


def test_first_of_skips_null_and_empty(spark):
    assert value(spark, tx.first_of("a", "b", "c"), a=None, b="", c="x") == "x"


def test_drop_words_keeps_longer_words(spark):
    assert value(spark, tx.drop_words("c", ["the", "ingredient"]), c="the leather ingredient  thyme the") == "leather thyme"


def test_after_last(spark):
    assert value(spark, tx.after_last("c", "what is"), c="what is a what is b") == " b"


def test_has_word(spark):
    assert value(spark, tx.has_word("c", ["add", "nova receita"]), c="haddock") is False
    assert value(spark, tx.has_word("c", ["add", "nova receita"]), c="please ADD it") is True
    assert value(spark, tx.has_word("c", ["add", "nova receita"]), c="uma nova receita") is True


def test_contains_is_literal_unless_asked(spark):
    assert value(spark, tx.contains_ci("c", "50%_"), c="at 50% off") is False
    assert value(spark, tx.contains_ci("c", "50%_"), c="at 50%_ off") is True
    assert value(spark, tx.contains_ci("c", "50%_", pattern=True), c="AT 50 OFF") is True


def test_split_first(spark):
    assert value(spark, tx.split_first("c", " - "), c="Flour - 200g - fine") == ["Flour", "200g - fine"]
    assert value(spark, tx.split_first("c", " - "), c="salt") == ["salt"]


def test_template_url_is_null_without_code(spark):
    assert value(spark, tx.template_url("http://x/", "c", ".png"), c="BR") == "http://x/br.png"
    assert value(spark, tx.template_url("http://x/", "c", ".png"), c=None) is None


def test_override(spark):
    column = tx.override("v", "k", {"Turkey": "TR", "Congo": "CG"})
    assert value(spark, column, k="Turkey", v=None) == "TR"
    assert value(spark, column, k="Peru", v="PE") == "PE"
    assert value(spark, column, k=None, v=None) is None


@pytest.mark.parametrize("text, day", [
    ("2024-03-01", date(2024, 3, 1)), ("2024-03-05 10:00:00", date(2024, 3, 5)), ("2024-13-05", None), (None, None),
    ("2024-1-5", date(2024, 1, 5)), ("2024-1-5 9:00", date(2024, 1, 5)), ("2024-01-05T09:00:00Z", date(2024, 1, 5)),
    ("soon", None), ("", None)])
def test_parse_day(spark, text, day):
    assert value(spark, tx.parse_day("c"), c=text) == day


def test_surrogate_key(spark):
    key = value(spark, tx.surrogate_key("src", "a", "b"), a="1", b="x")
    assert [len(p) for p in key.split("-")] == [8, 4, 4, 4, 12]
    assert key == value(spark, tx.surrogate_key("src", "a", "b"), a="1", b="x")
    others = [value(spark, tx.surrogate_key("src", "a", "b"), a="1", b=None),
              value(spark, tx.surrogate_key("src", "a", "b"), a=None, b="1"),
              value(spark, tx.surrogate_key("other", "a", "b"), a="1", b="x")]
    assert len({key, *others}) == 4


def test_preview(spark):
    assert value(spark, tx.preview("c", 5), c="abcde") == "abcde"
    assert value(spark, tx.preview("c", 5), c="abcdef") == "abcde..."


def test_percent_match(spark):
    shown = spark.createDataFrame([(0.824,), (0.825,), (0.0,), (None,)], "s double").select(tx.percent_match("s"))
    assert [r[0] for r in shown.collect()] == ["82% match", "83% match", None, None]


def test_to_int(spark):
    assert value(spark, tx.to_int("c"), c="007") == 7
    assert value(spark, tx.to_int("c"), c="-7") is None
    assert value(spark, tx.to_int("c"), c="99999999999999") is None


def test_starts_with_any(spark):
    assert value(spark, tx.starts_with_any("c", ["R", "T"]), c="Turkey") is True
    assert value(spark, tx.starts_with_any("c", ["R", "T"]), c="Peru") is False


def test_eq_ci(spark):
    assert value(spark, tx.eq_ci("c", "ITALY"), c="itaLy") is True
    assert value(spark, tx.day_text(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "2024-01-02 03:04:05"
