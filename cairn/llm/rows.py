"""Rows told apart by their contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType


def row_hash(df: DataFrame, inside: str = "") -> Column:
    """A hash of all columns; those that hold maps or variants, which Spark does not hash, by their JSON text.

    ``inside`` names the struct that holds the columns, if one does.
    """
    fields = df.schema[inside].dataType.fields if inside else df.schema.fields
    prefix = f"`{inside}`." if inside else ""
    values = [(F.col(f"{prefix}`{f.name}`"), f.dataType) for f in fields]
    return F.xxhash64(*[F.to_json(F.struct(value)) if unhashed(kind) else value for value, kind in values])


def unhashed(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return unhashed(kind.elementType)
    if isinstance(kind, StructType):
        return any(unhashed(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType | VariantType)
