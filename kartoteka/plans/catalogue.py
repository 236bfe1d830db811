"""The queries of a catalogue over its stored tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.nested import map_to_list
from kartoteka.operators.aggregates import facet_counts, table_counts
from kartoteka.operators.embedding import Encoder, WordHashing
from kartoteka.operators.filters import detail_by_key, mentions, where_ci
from kartoteka.operators.joins import join_spread
from kartoteka.operators.project import item_view
from kartoteka.operators.routing import PLACE_ALIASES, classify_chat, item_template, route_questions
from kartoteka.operators.topk import page
from kartoteka.operators.validate import to_items, validate_submissions
from kartoteka.plans.search import semantic_search

# Output name: column of item (i), category (c) or place (p).
CARD = {
    "id": "i.external_id_meal",
    "name": "i.name_meal",
    "category": "c.name",
    "area": "i.country",
    "thumbnail_url": "i.image_recipe",
}
FLAG = {"country_flag": "p.image"}
TEXT = {"instructions": "i.instructions", "youtube_url": "i.video_recipe"}
COMPONENTS = {"ingredient_measure": "i.ingredient_measure"}
KEY = {"__key": "i.id_guid_sk"}


@dataclass(frozen=True)
class Catalogue:
    """Stored tables, with the column names of `catalogue_contracts`."""

    items: DataFrame
    categories: DataFrame
    places: DataFrame
    components: DataFrame
    vectors: DataFrame | None = None

    def _view(self, columns: dict[str, str], placed: bool = True) -> DataFrame:
        return item_view(self.items, self.categories, self.places if placed else None, columns=columns)

    @staticmethod
    def _page(view: DataFrame, limit: int, offset: int = 0) -> DataFrame:
        """By name; items of one name by their key, which is not shown."""
        return page(view, ["name", "__key"], limit, offset).drop("__key")

    def list_items(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return self._page(self._view(CARD | TEXT | FLAG | KEY), limit, offset)

    def item(self, external_id: int) -> DataFrame:
        """One item with its components as a list; no row if there is none."""
        columns = CARD | TEXT | {"source_url": "i.source_url"} | COMPONENTS | {"date_modified": "i.date_modified"}
        return detail_by_key(self._view(columns, placed=False), "id", external_id).withColumn(
            "ingredients", map_to_list("ingredient_measure"))

    def by_category(self, category: str, limit: int = 5) -> DataFrame:
        columns = CARD | TEXT | COMPONENTS | {"category_image": "c.imagem"} | FLAG | KEY
        found = self._page(where_ci(self._view(columns), "category", category), limit)
        return found.withColumn("ingredients", map_to_list("ingredient_measure"))

    def by_place(self, place: str, limit: int = 50) -> DataFrame:
        return self._page(where_ci(self._view(CARD | FLAG | KEY), "area", place), limit)

    def search(self, term: str, limit: int = 50, pattern: bool = False) -> DataFrame:
        """Distinct items whose name, components or instructions mention the term."""
        hits = self.items.where(mentions(["name_meal", "ingredient_measure", "instructions"], term.strip(), pattern))
        view = item_view(hits, self.categories, columns=CARD).distinct()
        return page(view, ["name", "id", "area", "category", "thumbnail_url"], limit)

    def category_names(self) -> DataFrame:
        return self.categories.select(F.col("id_guid_sk").alias("id"), "name").orderBy("name", "id")

    def place_names(self) -> DataFrame:
        return self.places.select(F.col("id_guid_sk").alias("id"), F.col("country").alias("name")).orderBy("name", "id")

    def facets(self) -> DataFrame:
        return facet_counts(self.categories, self.items, "id_guid_sk", "guid_category", "name").orderBy("facet")

    def stats(self) -> DataFrame:
        return table_counts({"total_recipes": self.items, "total_categories": self.categories,
                             "total_countries": self.places})

    def answer(self, questions: DataFrame, aliases: DataFrame | Sequence[tuple[str, str]] = PLACE_ALIASES,
               key: str = "question_id", text: str = "text") -> DataFrame:
        """Rule-based answers: components, places, then item names; items with what their card shows."""
        view = self._view(CARD | FLAG | KEY)
        return route_questions(
            questions, key, text, items=view, item_key="__key", item_name="name", item_place="area",
            components=self.components, component_key="id_guid_sk", component_name="ingredient_name",
            description="description", aliases=aliases, card=["id", "category", "thumbnail_url", "country_flag"])

    def chat(self, questions: DataFrame, k: int = 5, make_encoder: Callable[[], Encoder] = WordHashing,
             key: str = "question_id", text: str = "text") -> DataFrame:
        """The form for those who want to add an item, similar items for everyone else.

        Every question has a row: its `type` is template, recipe_search, no_results or empty_query.
        A template's row has the form as JSON, in `template`.
        """
        routed = questions.select(key, text, classify_chat(text).alias("route"))
        found = semantic_search(
            routed.where(F.col("route") == "item_search"), self.vectors, self.items, self.places, self.categories, k,
            question_key=key, question_text=text, make_encoder=make_encoder)
        found = found.withColumnRenamed(key, "__question")
        answered = join_spread(routed, found, {key: "__question"})
        kind = (
            F.when(F.col("route") != "item_search", F.col("route"))
            .when(F.col("__question").isNull(), "no_results")
            .otherwise("recipe_search")
        )
        form = F.when(F.col("route") == "template", F.lit(json.dumps(item_template())))
        return answered.withColumns({"type": kind, "template": form}).drop("route", "__question")

    def submit(self, submissions: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(items to append, rejected submissions with the reason)."""
        accepted, rejected = validate_submissions(submissions, self.categories, self.places)
        return to_items(accepted, key), rejected
