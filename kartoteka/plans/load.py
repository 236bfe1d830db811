"""Full and incremental load of a catalogue from landed responses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartoteka.functions.nested import numbered_slots, wide_slots
from kartoteka.functions.text import override, surrogate_key, template_url
from kartoteka.operators.buckets import KeyBuckets
from kartoteka.operators.filters import modified_since
from kartoteka.operators.joins import denormalize, dim_lookup
from kartoteka.operators.project import rename_select, with_audit
from kartoteka.operators.tables import KEPT_ON_UPDATE, staged_table, upsert
from kartoteka.operators.topk import best_per_key
from kartoteka.sources.landing import (
    CATEGORY_FIELDS,
    COMPONENT_FIELDS,
    DETAIL_SLOTS,
    LISTING_FIELDS,
    PLACE_FIELDS,
    read_details,
    read_envelope,
    read_places,
    read_tagged_listings,
)

# Countries whose name differs from the reference file's, with their code.
CODE_EXCEPTIONS = {"Republic of the Congo": "CG", "Turkey": "TR"}

# Where a country's flag is found.
FLAG_PREFIX, FLAG_SUFFIX = "https://flags.restcountries.com/v5/w640/", ".png"


def categories_from(landed: DataFrame, source: str) -> DataFrame:
    return rename_select(landed, {
        "id_guid_sk": surrogate_key(source, F.lit("category"), "strCategory"),
        "external_id": F.col("idCategory").try_cast("int"),
        "name": "strCategory",
        "description": "strCategoryDescription",
        "imagem": "strCategoryThumb",
    })


def components_from(landed: DataFrame, source: str) -> DataFrame:
    return rename_select(landed, {
        "id_guid_sk": surrogate_key(source, F.lit("component"), "idIngredient"),
        "external_id": F.col("idIngredient").try_cast("int"),
        "ingredient_name": "strIngredient",
        "description": "strDescription",
        "type_ingredient": "strType",
        "image": "strThumb",
    })


def listings_from(landed: DataFrame, source: str) -> DataFrame:
    return rename_select(landed, {
        "id_guid_sk": surrogate_key(source, F.lit("item"), "idMeal"),
        "external_id_meal": "idMeal",
        "category_name": "category_name",
        "area": "strArea",
        "country": "strCountry",
        "meal": "strMeal",
        "image": "strMealThumb",
    })


def details_from(landed: DataFrame, source: str, slots: int = DETAIL_SLOTS) -> DataFrame:
    """Details with so many of their numbered components; read them with `detail_fields(slots)`."""
    return rename_select(landed, {
        "id_guid_sk": surrogate_key(source, F.lit("detail"), "idMeal"),
        "external_id": "idMeal",
        "meal": "strMeal",
        "category": "strCategory",
        "country": "strCountry",
        "instructions": "strInstructions",
        "ingredient_measure": wide_slots(landed, "strIngredient", "strMeasure", slots),
        "image": "strMealThumb",
        "video": "strYoutube",
        "source_url": "strSource",
        "date_modified": "dateModified",
    })


# Fields of a detail that have a column of their own, and how its numbered slots begin.
DETAIL_COLUMNS = {
    "external_id": "idMeal", "meal": "strMeal", "category": "strCategory", "country": "strCountry", "instructions": "strInstructions",
    "image": "strMealThumb", "video": "strYoutube", "source_url": "strSource", "date_modified": "dateModified",
}
SLOT_PREFIXES = ("strIngredient", "strMeasure")


def any_details_from(landed: DataFrame, source: str) -> DataFrame:
    """Details of `read_any_details`: all their slots, and fields without a column in `other_fields`."""
    field = lambda name: F.try_element_at(F.col("fields"), F.lit(name))
    known = [*DETAIL_COLUMNS.values()]
    other = F.map_filter("fields", lambda k, v: ~k.isin(known) & ~k.rlike(f"^({'|'.join(SLOT_PREFIXES)})[0-9]+$"))
    named = {name: field(of) for name, of in DETAIL_COLUMNS.items()}
    shaped = landed.select(*[c.alias(n) for n, c in named.items()], numbered_slots("fields", *SLOT_PREFIXES).alias("ingredient_measure"), other.alias("other_fields"))
    return shaped.select(surrogate_key(source, F.lit("detail"), "external_id").alias("id_guid_sk"), "*")


def places_from(landed: DataFrame, reference: DataFrame, source: str) -> DataFrame:
    """Places with code, region and flag; all NULL for a country the reference file lacks."""
    places = rename_select(landed, {
        "id_guid_sk": surrogate_key(source, F.lit("place"), "strCountry", "strArea"),
        "country": "strCountry",
        "cuisine": "strArea",
    })
    coded = dim_lookup(places, reference, ("country", "country"), {"acronym": "acronym"})
    coded = coded.withColumn("acronym", override("acronym", "country", CODE_EXCEPTIONS))
    placed = dim_lookup(coded, reference, ("acronym", "acronym"), {"region": "region"})
    return placed.withColumn("image", template_url(FLAG_PREFIX, "acronym", FLAG_SUFFIX))


@dataclass(frozen=True)
class Landing:
    """Folders with landed responses."""

    categories: str
    components: str
    listings: str
    details: str
    places: str
    reference: str
    multiline: bool = False
    reference_multiline: bool = True


def full_load(spark: SparkSession, landing: Landing, source: str, as_of: datetime | None = None) -> dict[str, DataFrame]:
    """The four stored tables: category, ingredients, country and recipe."""
    m = landing.multiline
    categories = categories_from(read_envelope(spark, landing.categories, "categories", CATEGORY_FIELDS, m), source)
    components = components_from(read_envelope(spark, landing.components, "meals", COMPONENT_FIELDS, m), source)
    listings = listings_from(read_tagged_listings(spark, landing.listings, "meals", LISTING_FIELDS, multiline=m), source)
    details = details_from(read_details(spark, landing.details, multiline=m), source)
    places = places_from(read_envelope(spark, landing.places, "meals", PLACE_FIELDS, m),
                         read_places(spark, landing.reference, landing.reference_multiline), source)
    tables = {
        "category": categories,
        "ingredients": components,
        "country": places,
        # the key of a detail follows from its external id and is stored nowhere: it need not be shuffled
        "recipe": denormalize(listings, categories, places, details.drop("id_guid_sk")),
    }
    return {name: with_audit(df, source, as_of) for name, df in tables.items()}


# What tells a row of a full load apart in each table.
LOAD_KEYS = {"category": ("id_guid_sk",), "ingredients": ("id_guid_sk",), "country": ("id_guid_sk",), "recipe": ("id_guid_sk",)}


def row_digest(df: DataFrame) -> Column:
    """Digest of what a row says; keys, times and its origin are in none."""
    said = sorted(c for c in df.columns if not c.startswith("__") and c != "id_guid_sk")
    return F.unhex(F.sha2(F.to_json(F.struct(*said), {"ignoreNullFields": "false"}), 256))


def load_changes(stored: DataFrame, loaded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The loaded rows, one for each key, with `change`: new, changed or same.

    Tables meet by key and digest only. A loaded key that repeats with other words counts once, the
    least digest winning, so that a second run finds the same.
    """
    loaded = loaded.withColumn("__digest", row_digest(loaded))
    once = best_per_key(loaded, keys, ["__digest"])
    known = stored.select(*[F.col(k).alias(f"__known_{k}") for k in keys], row_digest(stored).alias("__known_digest"))
    # each key is there once, also where it is NULL: rows stay where that was found out, and are not spread again
    met = once.join(known, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__known_{k}") for k in keys]), "left")
    change = F.when(F.col("__known_digest").isNull(), "new").when(F.col("__digest") == F.col("__known_digest"), "same").otherwise("changed")
    return met.withColumn("change", change).select(*[c for c in loaded.columns if c != "__digest"], "change")


def load_into(spark: SparkSession, tables: dict[str, DataFrame], root: str, run: str, buckets: int = 64) -> dict[str, DataFrame]:
    """Bring the tables of a full load into stored ones and return, for each, its rows with their change.

    New rows are added, changed ones take the loaded values and keep their first load time, the same
    ones are not touched: a load that runs twice leaves what one run leaves. Rows that a later load
    lacks stay.
    """
    changes = {}
    for name, loaded in tables.items():
        keys = LOAD_KEYS[name]
        store = KeyBuckets(f"{root}/{name}", loaded.schema, keys, buckets)
        listed = staged_table(load_changes(store.read(spark), loaded, keys), f"changes_{name}")
        updates = [c for c in loaded.columns if c not in (*keys, *KEPT_ON_UPDATE)]
        store.merge(listed.where("change <> 'same'").drop("change"), updates, batch=run, once=True)
        changes[name] = listed
    return changes


def loaded_table(spark: SparkSession, name: str, schema: T.StructType, root: str, buckets: int = 64) -> DataFrame:
    return KeyBuckets(f"{root}/{name}", schema, LOAD_KEYS[name], buckets).read(spark)


# What a match changes in a stored item; the key and the first load time stay.
ITEM_UPDATES = (
    "name_meal", "guid_category", "country", "region", "instructions", "ingredient_measure", "image_recipe",
    "video_recipe", "source_url", "date_modified", "__source", "__updated_at",
)
assert not set(ITEM_UPDATES) & set(KEPT_ON_UPDATE)


def staged_items(listings: DataFrame, categories: DataFrame, places: DataFrame, details: DataFrame, source: str,
                 as_of: datetime, days: int, modified: str = "date_modified", **how: object) -> DataFrame:
    """Items changed in the last days, joined and audited. The date test comes before every join; `how` goes to `denormalize`."""
    recent = modified_since(details, modified, as_of.date(), days)
    return with_audit(denormalize(listings, categories, places, recent, **how), source, as_of)


def incremental_upsert(
    target: DataFrame, staged: DataFrame, keys: Sequence[str] = ("external_id_meal",),
    update_cols: Sequence[str] = ITEM_UPDATES, newest_by: Sequence[Column] | None = None,
) -> DataFrame:
    """The target with the staged items merged in; an empty staged set changes nothing.

    The staged items are written first: merging reads them several times.
    """
    return upsert(target, staged_table(staged, "staged"), keys, update_cols, newest_by)
