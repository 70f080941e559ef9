"""Mappings over streams.

Maps without joins are stateless: `Mapper.map` of a streaming DataFrame is a streaming DataFrame of quads, in append
mode. A join of a streaming child with a static parent is a stream-static join. Set semantics without end need a bound:
`distinct_within` drops repeats within a watermark (an extension; finite streams have `map_to_model`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from quadloom.mapper import Mapper
from quadloom.plans.triples import COLUMNS
from quadloom.rdf.nquads import to_nquads


def write_stream(quads: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """N-Quads files of a stream of quads."""
    return to_nquads(quads).writeStream.format("text").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)


def map_batches(mapper: Mapper, stream: DataFrame, name: str, checkpoint: str, sink: Callable[[DataFrame, int], None], statics: dict[str, DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Every micro-batch of the stream mapped on its own, as a set, with all joins the mapping has; sink gets its quads.
    A join sees the records of the batch and of statics."""

    def each(batch: DataFrame, number: int) -> None:
        sink(mapper.map_to_model({**(statics or {}), name: batch}), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def distinct_within(quads: DataFrame, time: str, delay: str) -> DataFrame:
    """Quads with an event time, without those that come again within the delay."""
    return quads.withWatermark(time, delay).dropDuplicatesWithinWatermark(COLUMNS)
