"""Streams: continuous upserts into a collection, and neighbours of arriving queries.

An extension; the query language itself has no event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vectrine.operators.search import batch_search
from vectrine.sources.table import VectorTable


def upsert_stream(rows: DataFrame, table: VectorTable, checkpoint: str, now_ms: int, seq: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Puts each micro-batch of records into the table.

    The number of the last batch is saved with the table's commit, so a batch
    that is repeated after a failure is not put twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        done = int(table.files.latest()["about"].get(checkpoint, -1))
        if number <= done or batch.isEmpty():
            return
        table.put(batch, now_ms, seq, about={checkpoint: number})

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def neighbours_stream(queries: DataFrame, collection: DataFrame, k: int, sink, checkpoint: str, metric: str = "cosine") -> StreamingQuery:
    """Calls ``sink(found, number)`` with the ``k`` nearest records of each micro-batch of queries (qid, qvec)."""

    def run(batch: DataFrame, number: int) -> None:
        sink(batch_search(collection, batch, k, metric), number)

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
