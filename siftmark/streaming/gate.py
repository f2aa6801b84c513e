"""Ingest gate: new rows of a stream are scored against a stored table of carriers before they are let in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.operators.grams import record_scores

MAX_CARRIERS = 10_000


def gate(stream: DataFrame, carriers: DataFrame, accepted: str, held: str, checkpoint: str, threshold: float = 0.0):
    """Write rows that hold a carrier scored above the threshold to ``held`` and the others to ``accepted``.

    Each micro-batch is scored with the batch operator, so stream and batch agree. A batch replaces its own output when it is
    repeated after a failure, which makes the sinks exactly-once. The carriers are a shortlist of at most MAX_CARRIERS grams; more
    are an error, as they are broadcast. ``stream`` has ``row_idx`` and ``text``; a null text holds no carrier.
    """
    if carriers.limit(MAX_CARRIERS + 1).count() > MAX_CARRIERS:
        raise ValueError(f"more than {MAX_CARRIERS} carriers")

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        scored = batch.join(record_scores(batch.withColumn("text", F.coalesce("text", F.lit(""))), carriers), "row_idx")
        for path, keep in ((held, F.col("score") > threshold), (accepted, F.col("score") <= threshold)):
            scored.where(keep).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
