"""Micro-batches of chunks into the index, by the same diff as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.index import index_diff, points


def stream_index(chunks: DataFrame, model: str, load: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that, for each batch of whole documents, computes the diff against ``load()`` and hands the
    batch's points and the diff to ``apply``. Applying a batch twice gives the same index, so replays do no harm."""

    def step(batch: DataFrame, number: int) -> None:
        current = points(batch, model)
        apply(current, index_diff(current, load()), number)

    return chunks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
