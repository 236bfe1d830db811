"""Projections."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.nested import map_to_list
from kartoteka.functions.text import first_of, is_blank, percent_match, preview
from kartoteka.operators.joins import one_per_key

# Fixed values of the card: components shown and characters of text shown.
CARD_COMPONENTS = 8
CARD_TEXT = 200


def rename_select(df: DataFrame, mapping: Mapping[str, str | Column]) -> DataFrame:
    """Output columns in mapping order: `{new name: old name or expression}`."""
    return df.select(*[(F.col(old) if isinstance(old, str) else old).alias(new) for new, old in mapping.items()])


def with_audit(df: DataFrame, source: str, as_of: datetime | None = None) -> DataFrame:
    """Add `__source`, `__ingested_at` and `__updated_at`."""
    now = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    return df.withColumns({"__source": F.lit(source), "__ingested_at": now, "__updated_at": now})


def item_view(
    items: DataFrame,
    categories: DataFrame,
    places: DataFrame | None = None,
    *,
    category_key: tuple[str, str] = ("guid_category", "id_guid_sk"),
    place_key: tuple[str, str] = ("country", "country"),
    columns: Mapping[str, str] = {
        "id": "i.external_id_meal",
        "name": "i.name_meal",
        "category": "c.name",
        "area": "i.country",
        "thumbnail_url": "i.image_recipe",
        "instructions": "i.instructions",
        "youtube_url": "i.video_recipe",
    },
) -> DataFrame:
    """Items with their category (kept when missing) and place (dropped when missing).

    A place that is stored several times, once for each cuisine, does not repeat its items.

    Columns are named with `i.`, `c.` and `p.` for item, category and place.
    """
    view = items.alias("i").join(
        categories.alias("c"), F.col(f"i.{category_key[0]}") == F.col(f"c.{category_key[1]}"), "left")
    if places is not None:
        view = view.join(one_per_key(places, place_key[1]).alias("p"), F.col(f"i.{place_key[0]}") == F.col(f"p.{place_key[1]}"), "inner")
    return view.select(*[F.col(old).alias(new) for new, old in columns.items()])


def card_lines(entries: Column) -> Column:
    """`- component : measure` lines of the first components, then what is left over."""
    shown = F.filter(F.slice(entries, 1, CARD_COMPONENTS), lambda e: ~is_blank(e["ingredient"]))
    lines = F.transform(shown, lambda e: F.concat(
        F.lit("- "), e["ingredient"],
        F.when(first_of(e["measure"]).isNotNull(), F.concat(F.lit(" : "), e["measure"])).otherwise(F.lit(""))))
    left_over = F.size(entries) - F.size(shown)
    more = F.when(left_over > 0, F.array(F.concat(F.lit("+"), left_over.cast("string"), F.lit(" more..."))))
    return F.concat_ws("\n", lines, more)


def card_projection(
    df: DataFrame, *, key: str, names: list[str], components: str | None = None, text: str | None = None,
    similarity: str | None = None, text_length: int = CARD_TEXT,
) -> DataFrame:
    """Key, title, component lines, text preview and match percentage of each item."""
    out = [F.col(key), first_of(*names).alias("title")]
    if components is not None:
        out.append(card_lines(map_to_list(components)).alias("components"))
    if text is not None:
        out.append(preview(text, text_length).alias("preview"))
    if similarity is not None:
        out.append(percent_match(similarity).alias("match"))
    return df.select(*out)
