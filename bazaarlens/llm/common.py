"""Helpers shared by the text operators: Arrow text buffers, row maps and shared scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from bazaarlens.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(docs: DataFrame, *names: str) -> list[str]:
    """``names`` made unlike every column of ``docs``, which may use them itself."""
    taken = {c.lower() for c in docs.columns}
    mark = ""
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the ``rows + 1`` offsets into them; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(ends):
        ends = np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, text: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    _, ends = text_buffer(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
        stop = max(start + 1, min(stop, batch.num_rows))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    docs: DataFrame,
    columns: list[str],
    schema: str,
    work: Callable[[pa.RecordBatch], list[pa.Array]],
    limit: int = 1 << 22,
) -> DataFrame:
    """Apply ``work`` to runs of rows of ``columns``; the last one is the text.

    ``work`` gets an Arrow batch and gives the columns of ``schema``. Only the named
    columns reach Python, so other columns of ``docs`` never matter. A run has ``limit`` bytes of text
    or one row.
    """
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, batch.num_columns - 1, limit):
                yield pa.RecordBatch.from_arrays(work(piece), names=names)

    return docs.select(*columns).mapInArrow(run, schema)


def keep_rows(
    docs: DataFrame, text: str, keep: Callable[[pa.Array], np.ndarray], limit: int = 1 << 22
) -> DataFrame:
    """Rows whose text passes ``keep`` (a mask per run of rows), all columns as they are."""
    position = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, position, limit):
                mask = keep(piece.column(position))
                yield piece.filter(pa.array(np.asarray(mask, dtype=bool)))

    return docs.mapInArrow(run, docs.schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: computed once, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
