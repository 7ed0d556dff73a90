"""JSON of unknown shape, read without a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_value(text: Column | str) -> Column:
    """The text as a VARIANT; null where it is no JSON."""
    return F.try_parse_json(text)


def json_get(value: Column, path: str, kind: str = "string") -> Column:
    """What stands at ``path`` as ``kind``; null where the path is absent or the value cannot be read so."""
    return F.try_variant_get(value, path, kind)


def json_fields(df: DataFrame, value: str) -> DataFrame:
    """A row per field of each object, or element of each array, as (pos, key, value) beside the other columns of ``df``.

    ``pos`` is the place in the value's own order, ``key`` is null for array elements; a row whose value is neither,
    or null, gives none.
    """
    fields = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(value).outer()).toDF("pos", "key", "_field"))
    return fields.drop(value).withColumnRenamed("_field", "value")


def json_kind(value: Column) -> Column:
    """The kind of a VARIANT as a word: object, array, bigint, string and so on; ``void`` for a JSON null."""
    return F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Za-z]+", 0))
