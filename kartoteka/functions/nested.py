"""Component lists: wide slots, numbered maps, JSON text and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.text import WHITESPACE, is_blank, strip

ENTRY = "struct<ingredient:string,measure:string>"

# Position of numbers that no integer holds.
LAST = 2**63 - 1

# Fixed value: what stands between a component and its measure in typed lists.
PAIR_SEPARATOR = " - "


def _entry(component: Column, measure: Column) -> Column:
    return F.struct(component.alias("ingredient"), measure.alias("measure"))


def wide_to_map(components: Sequence[str | Column], measures: Sequence[str | Column]) -> Column:
    """Slot columns to `{"1": {ingredient, measure}, ...}`.

    The list ends at the first blank component: filled slots after it are lost.
    """
    as_array = lambda cols: F.array(*[F.col(c) if isinstance(c, str) else c for c in cols])
    return lists_to_map(as_array(components), as_array(measures))


def lists_to_map(names: Column, measures: Column) -> Column:
    """The same from two arrays of one length."""
    first_blank = F.array_position(F.transform(names, lambda c: is_blank(c)), True)
    filled = F.when(first_blank == 0, F.size(names)).otherwise((first_blank - 1).cast("int"))
    slots = F.zip_with(names, measures, lambda c, m: _entry(strip(c), F.coalesce(strip(m), F.lit(""))))
    kept = F.slice(slots, F.lit(1), filled)
    numbered = F.transform(kept, lambda e, i: F.struct((i + 1).cast("string").alias("key"), e.alias("value")))
    return F.map_from_entries(numbered)


def wide_slots(df: DataFrame, component_prefix: str, measure_prefix: str, n: int = 20) -> Column:
    """`wide_to_map` over numbered columns; slots the data does not have count as blank."""
    have = set(df.columns)
    pick = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    numbers = range(1, n + 1)
    return wide_to_map([pick(f"{component_prefix}{i}") for i in numbers],
                       [pick(f"{measure_prefix}{i}") for i in numbers])


def numbered_slots(fields: str | Column, component_prefix: str, measure_prefix: str) -> Column:
    """`wide_slots` over a map of field names to values, for as many slots as it has."""
    fields = F.col(fields) if isinstance(fields, str) else fields
    number = lambda name: F.substring(name, len(component_prefix) + 1, F.length(name)).try_cast("int")
    of_slots = F.filter(F.map_keys(fields), lambda name: name.rlike(f"^{component_prefix}[1-9][0-9]{{0,5}}$"))
    last = F.coalesce(F.array_max(F.transform(of_slots, number)), F.lit(0))
    numbers = F.filter(F.sequence(F.lit(0), last), lambda i: i > 0)
    pick = lambda prefix: F.transform(numbers, lambda i: F.try_element_at(fields, F.concat(F.lit(prefix), i.cast("string"))))
    return lists_to_map(pick(component_prefix), pick(measure_prefix))


def map_to_list(json_text: str | Column) -> Column:
    """JSON text to an ordered array of {ingredient, measure}.

    An object is ordered by its numeric keys, other keys last; an array passes
    through. Blank components are dropped. Anything unreadable gives an empty array.
    """
    text = F.col(json_text) if isinstance(json_text, str) else json_text
    # one odd value voids a map of structs: then every value is read on its own
    by_value = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda p: F.struct(
        p["key"].alias("key"), F.from_json(p["value"], ENTRY).alias("value")))
    pairs = F.coalesce(F.map_entries(F.from_json(text, f"map<string,{ENTRY}>")), by_value)
    ranked = F.transform(pairs, lambda p, i: F.struct(
        (~p["key"].rlike("^[0-9]+$")).alias("unnumbered"),
        F.when(p["key"].rlike("^[0-9]+$"), F.coalesce(p["key"].try_cast("bigint"), F.lit(LAST))).alias("position"),
        i.alias("at"),
        p["value"].alias("entry"),
    ))
    from_object = F.transform(F.array_sort(ranked), lambda r: _entry(
        strip(r["entry"]["ingredient"]), F.coalesce(strip(r["entry"]["measure"]), F.lit(""))))
    from_array = F.transform(F.from_json(text, "array<string>"), lambda v: F.from_json(v, ENTRY))
    listed = F.when(F.startswith(strip(text), F.lit("[")), from_array).otherwise(from_object)
    filled = F.filter(listed, lambda e: ~is_blank(e["ingredient"]))
    return F.coalesce(filled, F.from_json(F.lit("[]"), f"array<{ENTRY}>"))


def pairs_to_map(text: str | Column) -> Column:
    """`"a - 1; b - 2;"` to a numbered map. A pair without `" - "` uses up its number."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: strip(p))
    numbered = F.transform(F.filter(parts, lambda p: p != ""), lambda p, i: F.struct(
        (i + 1).cast("string").alias("key"), p.alias("pair"), F.instr(p, PAIR_SEPARATOR).alias("at")))
    whole = F.filter(numbered, lambda p: p["at"] > 0)
    return F.map_from_entries(F.transform(whole, lambda p: F.struct(
        p["key"].alias("key"),
        # the pair is stripped already, so each half has white space on one side only
        _entry(F.rtrim(F.substring(p["pair"], F.lit(1), p["at"] - 1), F.lit(WHITESPACE)),
               F.ltrim(F.substring(p["pair"], p["at"] + len(PAIR_SEPARATOR), F.length(p["pair"])), F.lit(WHITESPACE))
               ).alias("value"))))


def to_json_text(c: str | Column) -> Column:
    return F.to_json(F.col(c) if isinstance(c, str) else c)


def explode_components(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """One row per component, numbered from 1 in list order."""
    return (
        df.select(*keep, F.posexplode(map_to_list(json_col)).alias("position", "entry"))
        .select(*keep, (F.col("position") + 1).alias("position"), "entry.ingredient", "entry.measure")
    )
