"""What the operators share: tables, the shared folder, landed results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: space, and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"\x20\x09-\x0D"

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-process local session without that setting, as in tests, gets
    a temporary folder, one per application.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="llm-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_crc(id_col: str) -> Column:
    """Unsigned crc32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def in_fold(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32(id as text) mod ``modulus`` is ``remainder``; false for a null id."""
    return F.coalesce(id_crc(id_col) % modulus == remainder, F.lit(False))


def words(text: Column) -> Column:
    """Runs of characters other than ``WHITE``."""
    return F.array_remove(F.split(text, f"[{WHITE_CLASS}]+"), "")


def total(df: DataFrame, expr: Column) -> int:
    return int(df.agg(expr.alias("n")).first()["n"] or 0)
