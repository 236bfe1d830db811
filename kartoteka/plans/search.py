"""Embedding new items and searching them by meaning."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.nested import map_to_list
from kartoteka.functions.text import preview
from kartoteka.operators.embedding import Encoder, WordHashing, compose_text, embed
from kartoteka.operators.joins import measured, unprocessed
from kartoteka.operators.similarity import cosine_topk, cosine_topk_among
from kartoteka.operators.tables import staged_table
from kartoteka.operators.topk import best_per_key

# Fixed value: characters of matched text shown.
CHUNK_TEXT = 150


def embed_new(
    items: DataFrame, vectors: DataFrame, model_name: str, make_encoder: Callable[[], Encoder] = WordHashing,
    as_of: datetime | None = None, text: Column | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Rows to append to the vector table: one chunk for every item that has none.

    Items are recognised by their surrogate key, which user-added items have too. Columns of the item
    to `keep` (those that searches filter by) are stored beside its vector.
    """
    done = vectors.select(F.col("guid_recipe").alias("id_guid_sk"))
    fresh = unprocessed(items, done, ["id_guid_sk"])
    composed = text if text is not None else compose_text(
        "name_meal", "country", "region", "instructions", "ingredient_measure")
    now = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    rows = fresh.select("external_id_meal", F.col("id_guid_sk").alias("guid_recipe"), F.lit(0).alias("chunk_index"),
                        composed.alias("chunk_text"), *keep)
    # an item that is listed twice is embedded once, and only text is shuffled to find out
    once = best_per_key(rows, ["guid_recipe", "chunk_index"], ["chunk_text"])
    return embed(once, "chunk_text", make_encoder).withColumns({"model_name": F.lit(model_name), "created_at": now})


def _of_model(vectors: DataFrame, model_name: str | None) -> DataFrame:
    return vectors if model_name is None else vectors.where(F.col("model_name") == model_name)


def nearest_chunks(
    questions: DataFrame, vectors: DataFrame, items: DataFrame, k: int, *, question_key: str = "question_id",
    question_text: str = "text", make_encoder: Callable[[], Encoder] = WordHashing, key: str = "external_id_meal",
    show: Sequence[str] = ("name_meal", "country", "region"), model_name: str | None = None, **limits: int,
) -> DataFrame:
    """The k items nearest to each question by their external id, with the start of the text that matched.

    Items without an external id are not found; neither are vectors without an item. With a
    `model_name` only that model's vectors are searched.
    """
    vectors = _of_model(vectors, model_name)
    asked = staged_table(embed(questions.select(question_key, question_text), question_text, make_encoder, "__asked"), "asked")
    top = cosine_topk_among(vectors, asked, k, items, item=key, chunk="chunk_index", query=question_key,
                            query_vector="__asked", **limits)
    texts = vectors.select(key, F.col("chunk_index").alias("chunk"), preview("chunk_text", CHUNK_TEXT).alias("chunk_text"))
    # both wide tables are cut down to the winners before these meet
    winners = items.select(key, *show).join(measured(top.select(key)), key, "left_semi")
    return (
        texts.join(measured(top), [key, "chunk"]).join(winners, key)
        .select(question_key, "rank", key, *show, "chunk_text", F.round("similarity", 4).alias("similarity"))
    )


def semantic_search(
    questions: DataFrame, vectors: DataFrame, items: DataFrame, places: DataFrame, categories: DataFrame, k: int,
    *, question_key: str = "question_id", question_text: str = "text",
    make_encoder: Callable[[], Encoder] = WordHashing,
    item_key: str = "id_guid_sk", vector_item: str = "guid_recipe", chunk: str = "chunk_index",
    place_on: tuple[str, str] = ("country", "country"), category_on: tuple[str, str] = ("guid_category", "id_guid_sk"),
    columns: Mapping[str, str] = {
        "external_id_meal": "i.external_id_meal", "name_meal": "i.name_meal", "instructions": "i.instructions",
        "ingredient_measure": "i.ingredient_measure", "image_recipe": "i.image_recipe",
        "video_recipe": "i.video_recipe", "country": "i.country", "region": "i.region",
        "category_name": "c.name", "category_image": "c.imagem", "country_flag": "p.image",
    },
    components: str | None = "ingredient_measure", model_name: str | None = None, chunk_length: int = CHUNK_TEXT, **limits: int,
) -> DataFrame:
    """The k items most like each question, with item, place and category details.

    An item without place or category takes no slot; the wide detail columns only meet
    the rows that won. Where the vectors keep their item's place and category beside them, they are
    sorted out while they are read: one scan, in which no vector is shuffled. With a `model_name` only that model's vectors are searched. Where the
    vectors have their text, the start of what matched is `chunk_text`.
    """
    vectors = _of_model(vectors, model_name)
    asked = staged_table(embed(questions.select(question_key, question_text), question_text, make_encoder, "__asked"), "asked")
    known = {place_on[0]: places.select(F.col(place_on[1]).alias(place_on[0])).distinct(),
             category_on[0]: categories.select(F.col(category_on[1]).alias(category_on[0])).distinct()}
    how = dict(item=vector_item, chunk=chunk, query=question_key, query_vector="__asked", **limits)
    if set(known) <= set(vectors.columns):
        for column, keys in known.items():
            vectors = vectors.join(measured(keys), column, "left_semi")
        top = staged_table(cosine_topk(vectors, asked, k, **how), "nearest")
    else:
        whole = items.select(item_key, *known)
        for column, keys in known.items():
            whole = whole.join(keys, column, "left_semi")
        top = cosine_topk_among(vectors, asked, k, whole.select(F.col(item_key).alias(vector_item)), **how)
    if "chunk_text" in vectors.columns:
        texts = vectors.select(vector_item, (F.col(chunk) if chunk else F.lit(0)).cast("int").alias("chunk"), preview("chunk_text", chunk_length).alias("chunk_text"))
        # the text is read for the winners only, and once for each
        once = best_per_key(texts.join(measured(top.select(vector_item, "chunk").distinct()), [vector_item, "chunk"], "left_semi"),
                            [vector_item, "chunk"], ["chunk_text"])
        top = staged_table(top.join(measured(once), [vector_item, "chunk"], "left"), "matched")
    top = measured(top)
    # a place listed once per cuisine must not repeat the item
    places, categories = (
        best_per_key(dim, [on], [F.col(c).asc_nulls_last() for c in dim.columns])
        for dim, on in ((places, place_on[1]), (categories, category_on[1]))
    )
    detailed = (
        top.alias("t")
        .join(items.alias("i"), F.col(f"t.{vector_item}") == F.col(f"i.{item_key}"))
        .join(places.alias("p"), F.col(f"i.{place_on[0]}") == F.col(f"p.{place_on[1]}"))
        .join(categories.alias("c"), F.col(f"i.{category_on[0]}") == F.col(f"c.{category_on[1]}"))
        .select(f"t.{question_key}", "t.rank", f"t.{vector_item}", "t.chunk", "t.similarity", *(["t.chunk_text"] if "chunk_text" in top.columns else []),
                *[F.col(old).alias(new) for new, old in columns.items()])
    )
    return detailed.withColumn("components", map_to_list(components)) if components else detailed
