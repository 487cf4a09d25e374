"""Readers and sinks for tables, and the manifest of what was written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..operators.nesting import keyed_records, nested_to_json
from .schemas import RAW_TABLES

FORMATS = ("parquet", "csv", "json")


def _check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported table format: {fmt}")
    return fmt


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: str | StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A stored table. ``multi_line`` reads CSV values with line breaks; such files can't be split."""
    reader = spark.read.format(_check_format(fmt))
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=multi_line, escape='"')
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def fill_cores(df: DataFrame) -> DataFrame:
    """Spread a stored table over the cores if it has fewer splits than there are cores.

    For heavy work per row on few, small files; a table of many files passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_optional(
    spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet"
) -> DataFrame:
    """The table, or an empty one of the same schema if nothing lies at ``path``."""
    try:
        return read_table(spark, path, fmt, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_raw(spark: SparkSession, root: str, fmt: str = "json") -> dict[str, DataFrame]:
    """The six raw inputs, one folder each, with their explicit schemas."""
    return {
        name: read_table(spark, f"{root.rstrip('/')}/{name}", fmt, schema)
        for name, schema in RAW_TABLES.items()
    }


def read_keyed(df: DataFrame, map_column: str, key: str = "author_id") -> DataFrame:
    """A collection stored as one map id -> record as rows."""
    return keyed_records(df, map_column, key)


@dataclass(frozen=True)
class WrittenTable:
    table: str
    category: str
    rows: int
    cols: int
    path: str


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    *,
    nested_as_json: bool = False,
    arrays_as_text: Sequence[str] = (),
    mode: str = "errorifexists",
) -> tuple[int, int]:
    """Write a table and return (rows, columns); rows are counted during the write itself.

    CSV holds no nested values, so they become JSON text there; Parquet keeps them unless asked.
    """
    _check_format(fmt)
    if fmt == "csv" or nested_as_json:
        df = nested_to_json(df, [c for c in arrays_as_text if c in df.columns])
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"')
    writer.save(path)
    return seen.get["rows"], len(df.columns)


def write_tables(
    tables: Mapping[str, DataFrame], root: str, category: str, fmt: str, **options
) -> list[WrittenTable]:
    written = []
    for name in sorted(tables):
        path = f"{root.rstrip('/')}/{name}.{fmt}"
        rows, cols = write_table(tables[name], path, fmt, **options)
        written.append(WrittenTable(name, category, rows, cols, path))
    return written


def manifest(spark: SparkSession, written: Sequence[WrittenTable]) -> DataFrame:
    """One row per written table, sorted by name."""
    rows = [(w.table, w.category, w.rows, w.cols, w.path) for w in written]
    schema = "table STRING, category STRING, rows BIGINT, cols INT, path STRING"
    return spark.createDataFrame(rows, schema).orderBy("table")
