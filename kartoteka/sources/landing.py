"""Landed JSON responses to rows, always with a fixed schema and one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# A response that is not JSON stops the load: its rows would be missing without a trace.
STRICT = "FAILFAST"


def text_fields(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Field names of the landed responses (fixed values).
CATEGORY_FIELDS = text_fields(["idCategory", "strCategory", "strCategoryDescription", "strCategoryThumb"])
COMPONENT_FIELDS = text_fields(["idIngredient", "strIngredient", "strDescription", "strType", "strThumb"])
LISTING_FIELDS = text_fields(["idMeal", "strMeal", "strMealThumb", "strArea", "strCountry"])
DETAIL_NAMES = ["idMeal", "strMeal", "strCategory", "strArea", "strCountry", "strInstructions",
                "strMealThumb", "strYoutube", "strSource", "dateModified"]
DETAIL_SLOTS = 20


def detail_fields(slots: int = DETAIL_SLOTS) -> T.StructType:
    """Fields of a landed item with so many numbered components and measures."""
    return text_fields(DETAIL_NAMES + [f"{name}{i}" for name in ("strIngredient", "strMeasure") for i in range(1, slots + 1)])


DETAIL_FIELDS = detail_fields()
PLACE_FIELDS = text_fields(["strArea", "strCountry"])
SUBMISSION_FIELDS = text_fields(
    ["name_meal", "category", "country", "instructions", "ingredient_measure",
     "image_recipe", "video_recipe", "source_url"]
)
QUESTION_FIELDS = T.StructType(
    [T.StructField("question_id", T.LongType()), T.StructField("text", T.StringType())]
)
ISO_PLACE = T.StructType([
    T.StructField("name", text_fields(["common", "official"])),
    T.StructField("cca2", T.StringType()),
    T.StructField("subregion", T.StringType()),
])


def _enveloped(list_field: str, fields: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(list_field, T.ArrayType(fields))])


def read_envelope(
    spark: SparkSession, path: str | list[str], list_field: str, fields: T.StructType, multiline: bool = False
) -> DataFrame:
    """`{"<list_field>": [...]}` responses to one row per list element.

    Envelopes whose list is null or empty give no rows. With one response per
    line the files stay splittable; `multiline` is for pretty-printed responses.
    """
    envelopes = spark.read.schema(_enveloped(list_field, fields)).json(path, multiLine=multiline, mode=STRICT)
    return envelopes.select(F.inline(list_field))


def read_tagged_listings(
    spark: SparkSession, root: str, list_field: str, fields: T.StructType, tag: str = "category",
    tag_as: str = "category_name", multiline: bool = False,
) -> DataFrame:
    """All listings under `root/<tag>=<value>/`, each row tagged with its folder's value."""
    schema = _enveloped(list_field, fields).add(tag, T.StringType())
    envelopes = spark.read.schema(schema).json(root, multiLine=multiline, mode=STRICT)
    return envelopes.select(F.inline(list_field), F.col(tag).alias(tag_as))


def read_details(
    spark: SparkSession, path: str | list[str], fields: T.StructType = DETAIL_FIELDS,
    list_field: str = "meals", multiline: bool = False,
) -> DataFrame:
    """Item details, every column text; a field an item lacks is NULL."""
    return read_envelope(spark, path, list_field, fields, multiline)


def read_any_details(spark: SparkSession, path: str | list[str], list_field: str = "meals", multiline: bool = False) -> DataFrame:
    """Item details of any shape: one row per element, `fields` a map of all its fields to text.

    Responses are read as VARIANT, without a schema, so that neither a slot beyond those foreseen nor an
    unknown field is lost. Numbers and nested values are their JSON text; a field that is null is null.
    """
    whole = spark.read.option("singleVariantColumn", "response").json(path, multiLine=multiline, mode=STRICT)
    listed = whole.select(F.explode(F.try_variant_get("response", f"$.{list_field}", "array<variant>")).alias("element"))
    return listed.select(F.try_variant_get("element", "$", "map<string,string>").alias("fields"))


def read_places(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """Country reference file to (country, acronym, region)."""
    return spark.read.schema(ISO_PLACE).json(path, multiLine=multiline, mode=STRICT).select(
        F.col("name.common").alias("country"), F.col("cca2").alias("acronym"), F.col("subregion").alias("region")
    )


UNREADABLE = "unreadable"


def read_submissions(
    spark: SparkSession, path: str | list[str], extra: T.StructType | None = None, multiline: bool = False, strict: bool = True,
) -> DataFrame:
    """Submissions by field. If not strict, one that is not JSON is a row with its text in `unreadable` and nothing else."""
    fields = T.StructType((extra.fields if extra else []) + SUBMISSION_FIELDS.fields)
    if strict:
        return spark.read.schema(fields).json(path, multiLine=multiline, mode=STRICT)
    return spark.read.schema(fields.add(UNREADABLE, T.StringType())).json(
        path, multiLine=multiline, mode="PERMISSIVE", columnNameOfCorruptRecord=UNREADABLE)


def read_questions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(QUESTION_FIELDS).json(path, mode=STRICT)
