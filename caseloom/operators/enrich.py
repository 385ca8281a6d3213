"""Enrichment: sector list, country attributes, authority registry, sector codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import blank_to_empty, strip


def fill_forward(df: DataFrame, order_col: str, value_col: str, out_col: str, block_rows: int = 100_000) -> DataFrame:
    """Last non-null ``value_col`` at or before each row, in ``order_col`` order.

    ``order_col`` is a non-negative integer position.  Rows are cut into blocks
    of positions: within a block a window fills forward, and the value carried
    into a block comes from a window over one row per block, so no task sees
    more than a block of rows.
    """
    block = F.floor(F.col(order_col) / block_rows)
    cut = df.withColumn("_block", block)
    inside = Window.partitionBy("_block").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumn("_inside", F.last(value_col, ignorenulls=True).over(inside))
    last_of_block = (
        cut.filter(F.col(value_col).isNotNull())
        .groupBy("_block")
        .agg(F.max_by(value_col, order_col).alias("_last"))
    )
    upper = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.select("_block").distinct().join(last_of_block, "_block", "left")
        .select("_block", F.last("_last", ignorenulls=True).over(upper).alias("_carried"))
    )
    return (
        filled.join(carried, "_block", "left")
        .withColumn(out_col, F.coalesce("_inside", "_carried"))
        .drop("_block", "_inside", "_carried")
    )


def sector_dimension(listing: DataFrame) -> DataFrame:
    """``(ordinal, code, description)`` rows in list order to a lookup table.

    A row whose code is one upper-case letter starts a section that later codes
    inherit.  Of a repeated code the last row counts.
    """
    rows = listing.select(
        "ordinal",
        F.btrim(strip(F.col("code")), F.lit('"')).alias("code"),
        F.btrim(strip(F.col("description")), F.lit('"')).alias("description"),
    ).filter(F.col("code") != "")
    head = F.when(F.col("code").rlike(r"^\p{Lu}$"), F.col("code"))
    filled = fill_forward(rows.withColumn("_head", head), "ordinal", "_head", "section")
    return filled.groupBy("code").agg(
        F.max_by("description", "ordinal").alias("description"),
        F.max_by("section", "ordinal").alias("section"),
    )


def sector_lookup(df: DataFrame, sectors: DataFrame, code_col: str) -> DataFrame:
    """Replace ``code_col`` by ``isic_code, isic_desc, isic_section``.

    Exact code first, then its two leading characters, else the raw code alone.
    """
    wanted = F.btrim(strip(F.col(code_col)), F.lit('"'))
    dim = sectors.select("code", "description", "section")  # broadcast by its bytes, or sorted and merged (AQE)
    exact = dim.select(*[F.col(c).alias(f"_x_{c}") for c in dim.columns])
    division = dim.select(*[F.col(c).alias(f"_d_{c}") for c in dim.columns])
    joined = (
        df.withColumn("_wanted", wanted)
        .join(exact, F.col("_wanted") == F.col("_x_code"), "left")
        .join(
            division,
            # a row that needs no second look-up gets a key of its own, not a NULL shared by all
            F.when(F.col("_x_code").isNull() & (F.length("_wanted") >= 2), F.substring("_wanted", 1, 2))
            .otherwise(F.concat(F.lit("\u0000"), F.coalesce("_wanted", F.lit("")))) == F.col("_d_code"),
            "left",
        )
    )
    return joined.withColumns({
        "isic_code": F.coalesce("_x_code", "_d_code", code_col),
        "isic_desc": F.coalesce("_x_description", "_d_description", F.lit("")),
        "isic_section": F.coalesce("_x_section", "_d_section", F.lit("")),
    }).drop("_wanted", code_col, *[f"_{p}_{c}" for p in "xd" for c in dim.columns])


def sector_codes(c: Column) -> Column:
    """All sector codes of an answer: ``struct<primary, secondary, multi>``."""
    codes = F.array_distinct(F.regexp_extract_all(blank_to_empty(c), F.lit(r"(?<![0-9])([0-9]{2,4})(?![0-9])"), 1))
    return F.struct(
        F.try_element_at(codes, F.lit(1)).alias("primary"),
        F.slice(codes, 2, F.greatest(F.size(codes), F.lit(1))).alias("secondary"),
        (F.size(codes) > 1).cast("int").alias("multi"),
    )


def with_country_attributes(df: DataFrame, countries: DataFrame, code_col: str = "country_code") -> DataFrame:
    """Left join of ``countries(code, region, languages, ..)``; NULL when absent."""
    dim = countries.withColumnRenamed("code", "_code")
    return df.join(dim, F.upper(F.col(code_col)) == F.col("_code"), "left").drop("_code")
