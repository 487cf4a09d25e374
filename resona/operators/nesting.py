"""Ids, nested structs and arrays of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions.rulesets import POST_ID_NAMES

ID_COLUMNS = ("video_id", "author_id", "id")


def ensure_video_id(df: DataFrame) -> DataFrame:
    """The first of the known id columns that is present becomes ``video_id``, as text."""
    source = next((name for name in POST_ID_NAMES if name in df.columns), None)
    return df if source is None else df.withColumn("video_id", F.col(source).cast("string"))


def cast_ids(df: DataFrame) -> DataFrame:
    present = {c: F.col(c).cast("string") for c in ID_COLUMNS if c in df.columns}
    return df.withColumns(present) if present else df


def is_nested(data_type: DataType) -> bool:
    return isinstance(data_type, (StructType, ArrayType, MapType))


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not is_nested(f.dataType)]


def keep_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Projection on those of ``columns`` that exist, in the order asked for."""
    return df.select(*[c for c in columns if c in df.columns])


def struct_fields(schema: StructType, root: str, prefix: str) -> dict[str, Column]:
    """Leaf fields of a struct column: flat name (joined by ``_``) -> expression."""
    leaves: dict[str, Column] = {}
    for field in schema:
        path, name = f"{root}.`{field.name}`", f"{prefix}{field.name}"
        if isinstance(field.dataType, StructType):
            leaves.update(struct_fields(field.dataType, path, f"{name}_"))
        else:
            leaves[name] = F.col(path)
    return leaves


def flatten_struct(df: DataFrame, id_columns: Sequence[str], column: str, prefix: str) -> DataFrame:
    """Ids and the flattened struct; only the ids if the column is missing."""
    if column not in df.columns:
        return df.select(*id_columns)
    leaves = struct_fields(df.schema[column].dataType, f"`{column}`", prefix)
    return df.select(*id_columns, *[c.alias(n) for n, c in leaves.items() if n not in id_columns])


def explode_records(
    df: DataFrame, list_column: str, parent_columns: Sequence[str], prefix: str = ""
) -> DataFrame:
    """One row per record of an array of structs; null records and empty arrays give no row.

    A record field with the name of a parent column only fills in where the parent is null.
    """
    parents = [c for c in parent_columns if c in df.columns]
    if list_column not in df.columns:
        return df.select(*parents).limit(0)
    rows = df.select(*parents, F.explode(list_column).alias("_record")).filter("_record IS NOT NULL")
    leaves = struct_fields(rows.schema["_record"].dataType, "_record", prefix)
    own = [F.coalesce(F.col(p), leaves[p]).alias(p) if p in leaves else F.col(p) for p in parents]
    return rows.select(*own, *[c.alias(n) for n, c in leaves.items() if n not in parents])


def explode_values(
    df: DataFrame, list_column: str, parent_columns: Sequence[str], value: str, index: str | None = None
) -> DataFrame:
    """One row per non-null element, with its 1-based position among the non-null ones if asked."""
    kept = F.array_compact(F.col(list_column))
    if index is None:
        return df.select(*parent_columns, F.explode(kept).alias(value))
    rows = df.select(*parent_columns, F.posexplode(kept).alias("_pos", value))
    return rows.select(*parent_columns, value, (F.col("_pos") + 1).alias(index))


def keyed_records(df: DataFrame, map_column: str, key: str, record: str = "record") -> DataFrame:
    """A map id -> record (or list of records) as one row per entry."""
    rows = df.select(F.explode(map_column).alias(key, record))
    value = rows.schema[record].dataType
    if isinstance(value, StructType):
        return rows.select(key, *[F.col(f"{record}.`{f.name}`") for f in value if f.name != key])
    return rows


def nested_to_json(df: DataFrame, arrays_as_text: Sequence[str] = ()) -> DataFrame:
    """Structs, arrays and maps as JSON text (null fields kept), for flat files.

    Columns in ``arrays_as_text`` are arrays of text, joined by a comma and a blank instead.
    """
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if field.name in arrays_as_text:
            column = F.array_join(column, ", ")
        elif is_nested(field.dataType):
            column = F.to_json(column, {"ignoreNullFields": "false"})
        columns.append(column.alias(field.name))
    return df.select(*columns)


def distinct_pairs(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.select(first, second).filter(F.col(second).isNotNull()).dropDuplicates([first, second])
