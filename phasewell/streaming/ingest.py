"""Streaming ingest of patterns into a corpus (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from phasewell.operators.store import Store


def ingest(stream: DataFrame, store: Store, corpus: str, checkpoint: str, once: bool = False):
    """Starts a query that adds each micro-batch; patterns already present are skipped, so a replay changes nothing."""

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.insert(corpus, batch, on_duplicate="skip")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
