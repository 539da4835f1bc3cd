"""Changes to named fields at any depth of nested data, built from the schema as one Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text fields that are masked, and fields that are dropped. Fixed values.
MASKED = ("text", "raw_text", "raw_value", "normalized_value", "subject", "excerpt", "body")
EVIDENCE = ("evidence", "evidence_references", "location")


def map_fields(c: Column, kind: T.DataType, names: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """c with `change` applied to every string field called one of `names`, inside structs, arrays and map values."""
    if isinstance(kind, T.StructType):
        fields = [(change(c[f.name]) if f.name in names and isinstance(f.dataType, T.StringType) else map_fields(c[f.name], f.dataType, names, change)).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: map_fields(x, kind.elementType, names, change))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: F.when(k.isin(*names), change(v)).otherwise(v) if isinstance(kind.valueType, T.StringType) else map_fields(v, kind.valueType, names, change))
    return c


def drop_fields(c: Column, kind: T.DataType, names: tuple[str, ...]) -> Column:
    """c without the fields (and map keys) called one of `names`, at any depth, inside map values too; a struct that loses all its fields stays as null."""
    if isinstance(kind, T.StructType):
        kept = [drop_fields(c[f.name], f.dataType, names).alias(f.name) for f in kind.fields if f.name not in names]
        return F.when(c.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: drop_fields(x, kind.elementType, names))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(c, lambda k, v: ~k.isin(*names)), lambda k, v: drop_fields(v, kind.valueType, names))
    return c
