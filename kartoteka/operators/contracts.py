"""Table contracts: types, NOT NULL, unique keys and defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Contract:
    schema: T.StructType
    unique: tuple[tuple[str, ...], ...] = ()
    defaults: Mapping[str, Column | object] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


def contract_report(df: DataFrame, contract: Contract) -> DataFrame:
    """One row per rule with the number of rows that break it: NULLs, or rows beyond the first per key."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in contract.required])
    reports = [nulls.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(f"not null {c}") for c in contract.required]),
        F.array(*[F.col(c) for c in contract.required]))).alias("rule", "violations"))]
    for key in contract.unique:
        # NULL keys are no duplicates of each other
        keyed = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key]))
        per_key = keyed.groupBy(*key).agg(F.count("*").alias("n"))
        reports.append(per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
                       .select(F.lit("unique " + ", ".join(key)).alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, reports)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def apply_defaults(df: DataFrame, contract: Contract) -> DataFrame:
    """Fill missing and NULL columns that have a default, then order and cast as the contract says."""
    out = []
    for f in contract.schema.fields:
        have = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in contract.defaults:
            default = contract.defaults[f.name]
            have = F.coalesce(have, default if isinstance(default, Column) else F.lit(default))
        out.append(have.cast(f.dataType).alias(f.name))
    return df.select(*out)


def relax(contract: Contract, column: str) -> Contract:
    """The contract with one column allowed to be NULL."""
    fields = [T.StructField(f.name, f.dataType, f.nullable or f.name == column) for f in contract.schema.fields]
    return replace(contract, schema=T.StructType(fields))


def _schema(ddl: str, required: str) -> T.StructType:
    must = set(required.split())
    fields = T.StructType.fromDDL(ddl).fields
    return T.StructType([T.StructField(f.name, f.dataType, f.name not in must) for f in fields])


_AUDIT = "__source string, __ingested_at timestamp, __updated_at timestamp"
_AUDIT_REQUIRED = "__source __ingested_at __updated_at"


def _audited(ddl: str, required: str, source: str, unique: tuple[tuple[str, ...], ...]) -> Contract:
    return Contract(
        _schema(f"{ddl}, {_AUDIT}", f"{required} {_AUDIT_REQUIRED}"), unique,
        {"__source": source, "__ingested_at": F.current_timestamp(), "__updated_at": F.current_timestamp()},
    )


def catalogue_contracts(source: str) -> dict[str, Contract]:
    """Contracts of the five stored tables (column names are fixed values).

    Needs an active session, as the timestamp defaults are columns. Business keys are
    unique too: loading the same source twice must not double a dimension.
    """
    key = (("id_guid_sk",),)
    return {
        "category": _audited(
            "id_guid_sk string, external_id int, name string, description string, imagem string",
            "id_guid_sk external_id name", source, key + (("name",),)),
        "ingredients": _audited(
            "id_guid_sk string, external_id int, ingredient_name string, description string, "
            "type_ingredient string, image string",
            "id_guid_sk external_id ingredient_name", source, key + (("external_id",),)),
        "country": _audited(
            "id_guid_sk string, country string, cuisine string, acronym string, region string, image string",
            "id_guid_sk country", source, key + (("country", "cuisine"),)),
        "recipe": _audited(
            "id_guid_sk string, external_id_meal int, name_meal string, guid_category string, country string, "
            "region string, instructions string, ingredient_measure string, image_recipe string, "
            "video_recipe string, source_url string, date_modified string",
            "id_guid_sk name_meal guid_category country", source, key + (("external_id_meal",),)),
        "recipe_embeddings": Contract(
            _schema(
                "external_id_meal int, guid_recipe string, chunk_index int, chunk_text string, "
                "embedding array<float>, model_name string, created_at timestamp",
                "guid_recipe chunk_index chunk_text embedding model_name created_at"),
            (("guid_recipe", "chunk_index"),), {"created_at": F.current_timestamp()}),
    }
