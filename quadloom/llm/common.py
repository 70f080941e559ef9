"""Helpers shared by the operators: batched text functions, and (from the library) cutting lineage in the shared folder."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quadloom.shared import staged as staged

#: Texts of one Arrow batch are worked on in runs of at most so many bytes (a longer text is its own run).
RUN_BYTES = 1_000_000


def text_runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First text and end of each run."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = before = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, before + RUN_BYTES, "right")))
        yield at, end
        at, before = end, ends[end - 1]


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at its end what it has freed goes back to the system: the C library keeps it, and a worker that waits for its next
    task would hold it through the stages between."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
            trim(0)

    return whole


def map_text(
    df: DataFrame,
    keep: Sequence[str],
    text: str,
    fields: str,
    fn: Callable[[list[str | None]], list[list]],
) -> DataFrame:
    """Columns `keep` of df, and `fields` (DDL) as fn makes them from runs of whole texts of column `text`."""
    src = df.select(*[df[c] for c in keep], df[text].cast("string").alias("__text"))
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([*src.schema.fields[:-1], *added.fields])
    arrow = to_arrow_schema(schema)
    place = len(keep)
    if text in keep and src.schema[text].dataType == T.StringType():  # it goes to Python once
        place, src = list(keep).index(text), src.drop("__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in text_runs(batch.column(place)):
                made = fn(batch.column(place).slice(at, end - at).to_pylist())
                arrays = [batch.column(i).slice(at, end - at).cast(arrow.field(i).type) for i in range(len(keep))]
                arrays += [pa.array(c, type=arrow.field(len(keep) + j).type) for j, c in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return src.mapInArrow(giving_back(run), schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hex_bytes(col) -> F.Column:
    return F.lower(F.hex(col))
