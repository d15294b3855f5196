"""Training sums over a stream: moments merge by addition, so new rows update the client models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import training


def streaming_moments(rows: DataFrame, keys: list[str], phi: list[str]) -> DataFrame:
    """Moments of everything seen so far; state is one row a key."""
    if not rows.isStreaming:
        raise ValueError("a stream is needed")
    return training.moments(rows, keys, phi)


def write_models(moments: DataFrame, keys: list[str], d: int, gamma: float, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the models of the updated keys under ``path``, one folder a batch (``batch=<id>``); a batch that is
    run again replaces its folder."""

    def solve(updated: DataFrame, batch: int) -> None:
        training.solved(updated, keys, d, gamma).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return moments.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(solve).start()
