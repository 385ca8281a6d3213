"""Exact stratified samples: the rows with the smallest hashes of each stratum.

The hash is of a seed and the row's key, so a sample is the same on every run, a
larger one contains a smaller one, and samples of parts merge into the sample of
the whole.  Each task keeps no more rows of a stratum than may be drawn before
anything is shuffled, so a stratum with most of the rows is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_hash(key: Column, seed: int = 7) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def allocate(sizes: DataFrame, total: int) -> DataFrame:
    """``(stratum, n, take)``: ``total`` rows shared out in proportion to ``sizes (stratum, n)``, largest remainders first.

    No stratum gives more than it has; equal remainders go by the stratum.
    """
    everything = sizes.agg(F.sum("n")).first()[0] or 0
    if not everything:
        return sizes.withColumn("take", F.lit(0).cast("long"))
    wanted = min(total, everything)
    share = sizes.withColumns({"_whole": F.expr(f"(n * {wanted}) div {everything}"), "_rest": F.expr(f"(n * {wanted}) % {everything}")})
    given = share.agg(F.sum("_whole")).first()[0]
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), F.asc_nulls_first("stratum")))  # a row per stratum
    return share.withColumn("take", F.col("_whole") + (place <= wanted - given).cast("long")).drop("_whole", "_rest")


def stratified_sample(df: DataFrame, stratum: str, key: str, total: int, seed: int = 7) -> DataFrame:
    """``total`` rows of ``df`` in proportion to the strata, with ``sample_rank`` inside the stratum.

    Exact: each stratum gives precisely its share.  A NULL stratum is a stratum;
    rows of equal keys are told apart by nothing, so one of them may be left out.
    """
    sizes = df.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"))
    takes = allocate(sizes, total).select(F.col("stratum").alias("_stratum"), "take")
    most = takes.agg(F.max("take")).first()[0] or 0
    order = Window.partitionBy(stratum).orderBy("_hash", key)
    # the constant bound is what lets each task cut its rows before the shuffle
    drawn = df.withColumn("_hash", sample_hash(F.col(key), seed)).withColumn("sample_rank", F.row_number().over(order)).filter(F.col("sample_rank") <= int(most))
    return drawn.join(takes, F.col(stratum).eqNullSafe(F.col("_stratum"))).filter("sample_rank <= take").drop("_hash", "_stratum", "take")
