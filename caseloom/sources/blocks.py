"""Concatenated answer blocks as a splittable data source.

``spark.read.format("answer_blocks").option("rangeBytes", n).load(path)`` after
:func:`register`.  Files are cut in byte ranges; a range
owns the blocks whose ``Answer 1:`` line starts inside its range, so a file of
any size is read by many tasks and no block is read twice.  Short ranges that
follow each other are read by one task in one go, so the number of tasks grows
with the bytes and not with the number of ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from caseloom.operators.parse import block_array
from caseloom.sources import ranges

FORMAT = "answer_blocks"
SCHEMA = "source string, range_start long, position long, value string"
_START = re.compile(rb'^"?Answer 1:', re.M)
#: Characters per batch sent to the JVM.
BATCH_CHARS = 8 << 20
#: Ranges are read together in tasks of up to so many bytes, where that leaves about so many tasks.
TASK_BYTES, TASKS = 8 << 20, 64


class Ranges(InputPartition):
    """Ranges of a file that follow each other."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", ranges.RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        cuts = ranges.cut_together(self.path, self.range_bytes, TASK_BYTES, TASKS)
        return [Ranges(*r) for r in cuts] or [Ranges("", 0, 0)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, size, owner, position = [], 0, partition.start, 0
        for at, data in ranges.line_records(partition.path, partition.start, partition.end, _START):
            begin = at - at % self.range_bytes
            if begin != owner:
                owner, position = begin, 0
            text = data.decode(errors="replace")
            # only what precedes the first block of a file can fail to be one
            if text.lstrip().startswith(("Answer 1:", '"Answer 1:')):
                rows.append((owner, position, text))
                size, position = size + len(text), position + 1
            if size >= BATCH_CHARS:
                yield self._batch(partition, rows)
                rows, size = [], 0
        yield self._batch(partition, rows)

    @staticmethod
    def _batch(partition: Ranges, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        starts, positions, texts = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array([partition.path] * len(rows), pa.string()), pa.array(starts, pa.int64()),
             pa.array(positions, pa.int64()), pa.array(texts, pa.string())],
            ["source", "range_start", "position", "value"],
        )


class AnswerBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AnswerBlocks)


def with_record_index(blocks: DataFrame) -> DataFrame:
    """Adds ``record_index``, the place of a block in its file.

    The blocks of each range are counted, a window over one row per range adds
    the counts up, and a block's place is that of its range plus its own.
    """
    counts = blocks.groupBy("source", "range_start").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("source", "range_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # a row per range: small enough to be broadcast by its bytes, sorted and merged otherwise
    return blocks.join(base, ["source", "range_start"]).withColumn("record_index", (F.col("_before") + F.col("position")).cast("int")).drop("_before")


def responses(blocks: DataFrame) -> DataFrame:
    """``(source, record_index, response)`` of read blocks, each cut where a block begins that is not kept."""
    return with_record_index(blocks).select(
        "source", "record_index", F.try_element_at(block_array(F.col("value")), F.lit(1)).alias("response")
    )
