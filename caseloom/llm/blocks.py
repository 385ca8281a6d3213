"""Documents in blocks of bounded bytes, landed once as a bucketed table.

Operators that send what they found about many words to a few shards and get
answers back do so per block: a block's request is one packed row per shard, and
the answer joins the block's documents without moving their texts again, since
the table is bucketed by block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import fresh_path, total

BLOCK_BYTES = 8 << 20
#: Text bytes of a bucket, and the most buckets a table may have (Spark's default limit); beyond it buckets grow, blocks do not.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 100_000


def text_bytes(documents: DataFrame, text_col: str) -> int:
    return total(documents, F.sum(F.octet_length(F.col(f"`{text_col}`"))))


def blocked(documents: DataFrame, id_col: str, text_col: str, size: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, id, text), bucketed by block; a null text is empty. ``size``: bytes of all texts.

    Rows of a scan task that follow each other share a block until it is full, so
    copies, hot sources and equal ids are dealt like any other rows.
    """
    kind = documents.schema[id_col].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = seen + np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            seen = int(ends[-1]) if len(ends) else seen
            yield pa.RecordBatch.from_arrays([pa.array(base + ends // block_bytes), *batch.columns], ["block", "id", "text"])

    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    spark = documents.sparkSession
    buckets = min(MOST_BUCKETS, max(2 * spark.sparkContext.defaultParallelism, math.ceil(size / BUCKET_BYTES)))
    name = f"blocks_{uuid.uuid4().hex}"
    rows.mapInArrow(number, f"block long, id {kind}, text string").repartition(buckets, "block").write.bucketBy(buckets, "block").option(
        "path", fresh_path(spark, "blocks")
    ).saveAsTable(name)
    return spark.table(name)


def packed(sorted_numbers: np.ndarray) -> bytes:
    """Ascending unsigned numbers as steps, equal bytes of all steps together, which compress well."""
    steps = np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0))
    return steps.view(np.uint8).reshape(-1, steps.itemsize).T.tobytes()


def unpacked(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)
