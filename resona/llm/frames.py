"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import Scratch, cut, shared_folder, stored

__all__ = ["Scratch", "arrow_rows", "cut", "folder_uri", "held_out", "in_parts", "kept", "map_arrow", "read_docs", "small_batches", "stored", "table"]


T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_docs(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (and ``more``), so that no other column can clash with a working column."""
    return docs.select(*[F.col(f"`{c}`") for c in ("doc_id", "text", *more)])


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model learns from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def arrow_rows(batches: Iterable[pa.RecordBatch], *columns: str, most_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Each batch with the named columns as Python lists, a bounded number of bytes at a time."""
    for batch in batches:
        for part in in_parts(batch, most_bytes):
            yield part, [part.column(c).to_pylist() for c in columns]


def in_parts(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most_bytes`` at most (a single longer row stays whole)."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, int(rows * most_bytes / max(1, batch.nbytes)))
    for start in range(0, rows, step):
        part = batch.slice(start, step)
        if part.num_rows > 1 and part.nbytes > 2 * most_bytes:
            yield from in_parts(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema), most_bytes)
        else:
            yield part


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Within this, jobs hand rows to Python so many at a time: rows with long lists would make batches of hundreds of MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_kept: dict[tuple[str, ...], object] = {}
_asked: set[tuple[str, ...]] = set()


def kept(key: tuple[str, ...], make: Callable[[], T]) -> T:
    """A worker's table, kept between tasks until one of another key is asked for, or a task ends that asked for none: a worker holds one at a time."""
    _asked.add(key)
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def begin_task() -> None:
    _asked.clear()


def end_task() -> None:
    """Drop a table of earlier tasks that this one did not ask for, and return free memory to the machine: workers wait for
    further tasks beside a busy JVM, and a later stage that needs no table would have the last one beside it all the time."""
    if not _asked:
        _kept.clear()
    release()


def release() -> None:
    """Return free memory to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what one of them took is returned before the next is read, or a task keeps the most that any needed."""
    for batch in batches:
        yield batch
        del batch
        release()


def map_arrow(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose workers keep no free memory between batches and tasks, and no table that no task asks for any more."""

    # Functions of this module, so that they work on the worker's own copy of it.
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        try:
            yield from task(released(batches))
        finally:
            end_task()

    return df.mapInArrow(lean, schema)


def folder_uri(spark: SparkSession, name: str) -> str:
    """A path in the shared folder as a URI that both Spark and Arrow's file systems open."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    path = re.sub(r"^file:/+", "file:///", path)
    return path if re.match(r"\w+://", path) else f"file://{path}"
