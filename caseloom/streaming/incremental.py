"""Incremental runs with Structured Streaming over the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.parse import parse_answers
from caseloom.operators.qa import available_fields


def parse_stream(responses: DataFrame) -> DataFrame:
    """The batch parser on a stream: it keeps no state."""
    return parse_answers(responses)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived, append it to Parquet, stop.  Exactly once per checkpoint."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drop_redelivered(stream: DataFrame, id_col: str = "decision_id", time_col: str = "ingestion_timestamp",
                     delay: str = "1 day") -> DataFrame:
    """Keep a decision once within ``delay`` of its first delivery; a delivery after that counts again.

    One state per decision: a copy that is dropped must not prolong the horizon.
    """
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def running_status_counts(wide: DataFrame, time_col: str = "ingestion_timestamp", width: str = "1 day",
                          delay: str = "1 day") -> DataFrame:
    """``(window, field_prefix, status, n)`` as running counts."""
    fields = available_fields(wide.columns)
    cells = F.array(*[
        F.struct(F.lit(p).alias("field_prefix"), F.col(f"{p}_status").alias("status")) for p in fields
    ])
    return (
        wide.withWatermark(time_col, delay).select(time_col, F.explode(cells).alias("c"))
        .groupBy(F.window(time_col, width).alias("window"), "c.field_prefix", "c.status")
        .agg(F.count("*").alias("n"))
    )


def upsert_available(stream: DataFrame, keys: list[str], value_col: str, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregation in update mode over what has arrived; return its latest state.

    Each batch writes only the groups it changed, under its batch id.  A batch
    that is run again replaces its own files.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return latest_state(stream.sparkSession.read.parquet(path), keys, value_col)


def latest_state(updates: DataFrame, keys: list[str], value_col: str) -> DataFrame:
    """The newest value of every group from the update files."""
    return updates.groupBy(*keys).agg(F.max_by(value_col, "batch").alias(value_col))
