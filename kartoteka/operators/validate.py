"""Checks of user submissions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.nested import pairs_to_map, to_json_text
from kartoteka.functions.text import day_text, is_blank, strip, surrogate_key
from kartoteka.operators.aggregates import distinct_values
from kartoteka.operators.joins import resolve_names
from kartoteka.operators.tables import staged_table
from kartoteka.sources.landing import UNREADABLE

# Places listed for an unknown place, and how many the hint names.
LISTED_PLACES = 20
HINTED_PLACES = 10
USER_SOURCE = "input_user"


def _first_names(df: DataFrame, name: str, listed: int, out: str) -> DataFrame:
    """One row: the first names in order."""
    first = distinct_values(df.where(F.col(name).isNotNull()), name, listed)
    return first.agg(F.array_sort(F.collect_list(name)).alias(out))


def place_hints(places: DataFrame, name: str = "country", listed: int = LISTED_PLACES, hinted: int = HINTED_PLACES) -> DataFrame:
    """One row: the first place names in order, and a hint with the first few of them."""
    return _first_names(places, name, listed, "available_places").select("available_places", F.concat(
        F.lit("Try one of: "), F.array_join(F.slice("available_places", 1, hinted), ", ")).alias("hint"))


def check_submissions(
    submissions: DataFrame, categories: DataFrame, places: DataFrame, *, category_key: str = "id_guid_sk",
    category_name: str = "name", place_name: str = "country", region: str = "region",
) -> DataFrame:
    """Submissions with their category key, place, region, and the first rule they break, or NULL.

    Where they have a column `unreadable`, a submission with something in it is rejected for that.
    """
    found = resolve_names(submissions, "category", categories, category_name,
                          {"guid_category": category_key, "__category": category_name})
    found = resolve_names(found, "country", places, place_name, {"__place": place_name, "region": region})
    readable = F.col(UNREADABLE).isNull() if UNREADABLE in submissions.columns else F.lit(True)
    reason = (
        F.when(~readable, "not readable")
        .when(is_blank("category"), "category is required")
        .when(F.col("__category").isNull(), "category not found")
        .when(is_blank("country"), "country is required")
        .when(F.col("__place").isNull(), "country not found")
        .when(is_blank("name_meal"), "name is required")
    )
    return (
        found.withColumn("reason", reason)
        .withColumn("country", F.coalesce(F.col("__place"), F.col("country")))
        .drop("__place", "__category")
    )


def validate_submissions(submissions: DataFrame, categories: DataFrame, places: DataFrame,
                         **names: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected), from one pass over the submissions, which is written.

    Rejections for an unknown place carry the first places and a hint, those for an unknown
    category the first categories.
    """
    checked = staged_table(check_submissions(submissions, categories, places, **names), "checked")
    accepted = checked.where(F.col("reason").isNull()).drop("reason", UNREADABLE)
    hints = place_hints(places, names.get("place_name", "country"))
    valid = _first_names(categories, names.get("category_name", "name"), LISTED_PLACES, "valid_categories").scalar()
    no_place, no_category = F.col("reason") == "country not found", F.col("reason") == "category not found"
    rejected = checked.where(F.col("reason").isNotNull()).select(
        *submissions.columns, "reason", F.when(no_place, hints.select("hint").scalar()).alias("hint"),
        F.when(no_place, hints.select("available_places").scalar()).alias("available_places"),
        F.when(no_category, valid).alias("valid_categories"))
    return accepted, rejected


def to_items(accepted: DataFrame, key: str | None = None, as_of: datetime | None = None) -> DataFrame:
    """Accepted submissions as stored items without an external id, ready for the audited append.

    The surrogate key comes from `key`, or from all submitted fields when there is none.
    """
    texts = ["name_meal", "instructions", "image_recipe", "video_recipe", "source_url"]
    identity = [key] if key else [*texts, "guid_category", "country", "ingredient_measure"]
    now: Column = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    return accepted.select(
        surrogate_key(USER_SOURCE, *identity).alias("id_guid_sk"),
        F.lit(None).cast("int").alias("external_id_meal"),
        strip("name_meal").alias("name_meal"),
        "guid_category", "country", "region",
        strip("instructions").alias("instructions"),
        to_json_text(pairs_to_map("ingredient_measure")).alias("ingredient_measure"),
        *[strip(c).alias(c) for c in texts[2:]],
        day_text(now).alias("date_modified"),
    )
