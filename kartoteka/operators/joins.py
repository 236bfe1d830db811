"""Joins that hold up when one key, or no key at all, fills a third of the table.

Spark broadcasts a table whose size it knows to be under its threshold, and adaptive
execution splits skewed partitions of the rest. It cannot know the size of a side
that is itself the result of joins before it has started to shuffle the other one:
such a side is measured first, and broadcast by hint only when it is small.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartoteka.functions.nested import to_json_text
from kartoteka.functions.text import blank_to_null
from kartoteka.operators.topk import best_per_key

_SPREAD = "__spread"
_SPREAD_BUCKETS = 1 << 20  # more than any shuffle has partitions
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def _row_hash(df: DataFrame) -> Column:
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return F.xxhash64(*[F.col(c) for c in plain])


def join_spread(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "left") -> DataFrame:
    """Left or anti join on `{left column: right column}`; the right columns are kept.

    Left rows with a NULL key match nothing. They still have to come out, and a
    shuffle would send them all to one task, so they are spread by a hash of the row.
    """
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    spread = F.when(no_key, F.pmod(_row_hash(left), F.lit(_SPREAD_BUCKETS)) + 1).otherwise(F.lit(0))
    # always 0, but not a literal: the optimizer would turn that into a filter
    always_zero = F.pmod(F.xxhash64(*[F.col(k) for k in on.values()]), F.lit(1))
    l, r = left.withColumn(_SPREAD, spread).alias("l"), right.withColumn(_SPREAD, always_zero).alias("r")
    condition = reduce(
        lambda a, b: a & b,
        [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in on.items()] + [F.col(f"l.{_SPREAD}") == F.col(f"r.{_SPREAD}")],
    )
    joined = l.join(r, condition, how)
    if how in ("left_anti", "left_semi"):
        return joined.select(*[F.col(f"l.{c}") for c in left.columns])
    return joined.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns])


def _width(df: DataFrame) -> Column:
    """Roughly the bytes of a row."""
    sizes = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
        elif not isinstance(f.dataType, T.AtomicType):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)))
    return reduce(lambda a, b: a + b, sizes, F.lit(16 * len(df.columns))).cast("bigint")


def measured(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The frame, marked for broadcast if counting its bytes showed it to be small."""
    size = df.agg(F.coalesce(F.sum(_width(df)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= max_bytes else df


HOT_SHARE = 0.02  # a key with so much of all rows is hot; there are 50 at most
_TRACKED = 10_000  # keys that the sketch keeps counters for


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """The keys that have at least so much of all rows, by a sketch of frequent items: 1 / share at most.

    The sketch overestimates by less than 1 / 2,500 of all rows, so that no hot key is missed.
    """
    found = df.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.call_function("approx_top_k", F.col(key), F.lit(math.ceil(1 / share)), F.lit(_TRACKED)).alias("top")).first()
    return [r["item"] for r in found.top or [] if r["count"] >= share * found.n]


def join_hot(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "inner", share: float = HOT_SHARE) -> DataFrame:
    """Inner or left join in which hot keys of the left side are not shuffled.

    They are measured first. The right rows of hot keys are few keys' worth, and are broadcast if
    their bytes are few as well; left rows with these keys then stay where they are. All other rows,
    those without a key among them, are shuffled as usual. Only the first column of `on` is measured.
    """
    first, other = next(iter(on.items()))
    hot = hot_keys(left, first, share)
    if not hot:
        return join_spread(left, right, on, how)
    is_hot = F.coalesce(F.col(first).isin(hot), F.lit(False))
    side = measured(right.where(F.col(other).isin(hot)))
    condition = reduce(lambda a, b: a & b, [left[a] == side[b] for a, b in on.items()])
    few = left.where(is_hot).join(side, condition, how).select(*[left[c] for c in left.columns], *[side[c] for c in right.columns])
    return few.unionByName(join_spread(left.where(~is_hot), right.where(~F.col(other).isin(hot) | F.col(other).isNull()), on, how))


def unprocessed(items: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items whose key is not in `done`; items without a key are always returned.

    Only keys are compared; the wide items then meet the keys that are left, without a
    shuffle when those are few, as after an incremental load.
    """
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    left = items.select(*keys).where(has_key).join(done.select(*keys), list(keys), "left_anti")
    fresh = items.join(measured(left), list(keys), "left_semi")
    return fresh.unionByName(items.where(~has_key))


def one_per_key(df: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """One row for each key: the newest, if a column tells, then the first by its plain columns; rows without a key are left out, as a join would."""
    order = [F.col(newest).desc_nulls_last()] if newest in df.columns else []
    order += [F.col(f.name).asc_nulls_last() for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return best_per_key(df.where(F.col(key).isNotNull()), [key], order)


def dim_lookup(df: DataFrame, dim: DataFrame, on: tuple[str, str], take: Mapping[str, str],
               last_by: Sequence[Column] | None = None) -> DataFrame:
    """Add columns of a dimension `{new name: dimension column}`; NULL where the key is unknown.

    A dictionary keeps the last of several equal keys: `last_by` lists the orderings that
    put it first. Without it, the greatest values win, so the result is the same each run.
    """
    key, dim_key = on
    order = list(last_by) if last_by else [F.col(c).desc_nulls_last() for c in take.values()]
    one_each = best_per_key(dim.where(F.col(dim_key).isNotNull()), [dim_key], order)
    looked_up = one_each.select(F.col(dim_key).alias("__dim_key"), *[F.col(c).alias(n) for n, c in take.items()])
    return join_spread(df, measured(looked_up), {key: "__dim_key"}).drop("__dim_key")


def denormalize(
    listings: DataFrame, categories: DataFrame, places: DataFrame, details: DataFrame,
    *,
    category_on: tuple[str, str] = ("category_name", "name"),
    place_on: tuple[str, str] = ("country", "country"),
    detail_on: tuple[str, str] = ("external_id_meal", "external_id"),
    newest: str = "date_modified",
    columns: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Inner star join of listing, category, place and detail to the stored item columns.

    The dimensions come first: they are usually broadcast, and rows they drop
    need not be shuffled to meet their details. A place is stored once for each of its
    cuisines, and an item may be listed twice: each counts once, so that an item is one row. Of several
    details of an item the newest counts.
    """
    known = (listings.alias("r")
             .join(categories.alias("c"), F.col(f"r.{category_on[0]}") == F.col(f"c.{category_on[1]}"), "left_semi")
             .join(places.alias("co"), F.col(f"r.{place_on[0]}") == F.col(f"co.{place_on[1]}"), "left_semi"))
    joined = (
        one_per_key(known, detail_on[0]).alias("r")
        .join(one_per_key(categories, category_on[1]).alias("c"), F.col(f"r.{category_on[0]}") == F.col(f"c.{category_on[1]}"))
        .join(one_per_key(places, place_on[1]).alias("co"), F.col(f"r.{place_on[0]}") == F.col(f"co.{place_on[1]}"))
        .join(one_per_key(details, detail_on[1], newest).alias("rf"), F.col(f"r.{detail_on[0]}") == F.col(f"rf.{detail_on[1]}"))
    )
    chosen = columns if columns is not None else {
        "id_guid_sk": "r.id_guid_sk",
        "external_id_meal": F.col("r.external_id_meal").try_cast("int"),
        "name_meal": "r.meal",
        "guid_category": "c.id_guid_sk",
        "country": "r.country",
        "region": "co.region",
        "instructions": "rf.instructions",
        "ingredient_measure": to_json_text("rf.ingredient_measure"),
        "image_recipe": "rf.image",
        "video_recipe": "rf.video",
        "source_url": "rf.source_url",
        "date_modified": "rf.date_modified",
    }
    return joined.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in chosen.items()])


def resolve_names(df: DataFrame, column: str, dim: DataFrame, dim_name: str, take: Mapping[str, str]) -> DataFrame:
    """Look names up in any case; one dimension row per name, the first in binary order."""
    rows = dim.withColumn("__name", F.lower(dim_name))
    one_each = best_per_key(rows.where(F.col("__name").isNotNull()), ["__name"],
                            [F.col(c).asc_nulls_last() for c in dict.fromkeys([dim_name, *take.values()])])
    looked_up = one_each.select("__name", *[F.col(c).alias(n) for n, c in take.items()])
    asked = df.withColumn("__asked", F.lower(blank_to_null(column)))
    return join_spread(asked, measured(looked_up), {"__asked": "__name"}).drop("__asked", "__name")
