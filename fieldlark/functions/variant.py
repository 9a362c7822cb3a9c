"""Free-form properties as VARIANT: parsed once, read by path and type, their schema summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The VARIANT of a JSON text; null where it is null or malformed."""
    return F.try_parse_json(text)


def field(v: Column, path: str, kind: str) -> Column:
    """What stands at ``path``, as ``kind``; null where nothing does or it is of another kind."""
    return F.try_variant_get(v, path, kind)


def document(v: Column) -> Column:
    """The VARIANT as JSON, keys in order."""
    return F.to_json(v)


def schemas(df: DataFrame, v: str, keys: list[str]) -> DataFrame:
    """(keys, schema): the least type that all values of a key fit, summed in every task."""
    return df.groupBy(*keys).agg(F.schema_of_variant_agg(F.col(v)).alias("schema"))
