"""Small helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contigua.runtime import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_col: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall into no fold."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text under private names, so that other columns can't clash; the package goes to the workers."""
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))


def text_digest(text: Column) -> Column:
    """SHA-256 of a text as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


Body = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Body) -> Body:
    """A ``mapInArrow`` body that hands freed memory back to the system when its task ends: workers live on after it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def per_text(fn: Callable[[str], tuple], fields: list[pa.Field], rename: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` body that calls ``fn`` on every text (null: empty) and appends its results after ``_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            rows = [fn(x.as_py() or "") for x in texts]
            cols = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)]], names=[rename or "_id", *[f.name for f in fields]])

    return run
