"""Typed scalars: every value keeps its raw text and a status beside it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.functions.text import blank_to_empty

_DATE_SHAPE = r"^(?!0000)[0-9]{4}-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])$"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def flag(condition: Column) -> Column:
    """0/1 with missing counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def is_schema_echo(c: Column) -> Column:
    """The answer repeats the question's type declaration."""
    trimmed = blank_to_empty(c)
    return any_of([F.startswith(trimmed, F.lit(p)) for p in vocab.ECHO_PREFIXES])


# --- dates -------------------------------------------------------------------
def clean_date(c: Column) -> Column:
    """``struct<raw, value date, status, error>``."""
    raw = blank_to_empty(c)
    parsed = F.when(raw.rlike(_DATE_SHAPE), F.try_to_date(F.replace(raw, F.lit(" "), F.lit("")), "yyyy-M-d"))
    status = (
        F.when(raw == "", "NOT_MENTIONED")
        .when(raw.isin(*vocab.DATE_STATUS_TOKENS), raw)
        .when(parsed.isNotNull(), "DISCUSSED")
        .otherwise("PARSE_ERROR")
    )
    return F.struct(
        raw.alias("raw"),
        parsed.alias("value"),
        status.alias("status"),
        F.when(status == "PARSE_ERROR", "invalid_date").alias("error"),
    )


def iso_timestamp(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd'T00:00:00+00:00'")


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))


# --- numbers -----------------------------------------------------------------
def sanitize_number(c: Column) -> Column:
    """Keep digits, signs, separators and exponent letters; one dot at most."""
    kept = F.regexp_replace(c, "[^0-9eE+\\-., ]+", "")
    joined = F.translate(kept, " ,", "")
    return F.regexp_replace(joined, "\\.(?=.*\\.)", "")


def once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then(c)`` with ``c`` evaluated once per row, however often ``then`` names it."""
    return F.transform(F.array(c), then)[0]


def clean_number(c: Column) -> Column:
    """``struct<raw, value double, status, valid, error>``; each text is read once."""
    return once(blank_to_empty(c), lambda raw: once(sanitize_number(raw), lambda text: _typed_number(raw, text)))


def _typed_number(raw: Column, text: Column) -> Column:
    number = text.try_cast("double")
    status = (
        F.when(raw == "", "NOT_MENTIONED")
        .when(raw.isin(*vocab.NUMBER_STATUS_TOKENS), raw)
        .when(number.isNull(), "PARSE_ERROR")
        .when(number < 0, "NEGATIVE_VALUE")
        .otherwise("DISCUSSED")
    )
    return once(status, lambda state: F.struct(
        raw.alias("raw"),
        F.when(state == "DISCUSSED", number).alias("value"),
        state.alias("status"),
        (~state.isin("PARSE_ERROR", "NEGATIVE_VALUE")).alias("valid"),
        F.when((state == "PARSE_ERROR") & (text == ""), "sanitized_numeric_string_empty")
        .when(state == "PARSE_ERROR", "invalid_number")
        .when(state == "NEGATIVE_VALUE", "value_lt_zero").alias("error"),
    ))


def strict_money(c: Column) -> Column:
    """Opt-in amount reader: a currency word or sign is allowed on either side
    and a European ``1.234.567,89`` is told apart from ``1,234,567.89``.

    Returns ``struct<value decimal(20,6), currency>``; NULL value when the text
    is not one plain amount.
    """
    raw = blank_to_empty(c)
    currency = F.upper(F.regexp_extract(raw, r"([A-Za-z]{3}|[\u20ac\u00a3$])", 1))
    digits = F.regexp_replace(raw, r"^([A-Za-z]{3}|[\u20ac\u00a3$])\s*|\s*([A-Za-z]{3}|[\u20ac\u00a3$])$|[\s\u00a0']", "")
    number = (
        F.when(digits.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$"), F.translate(digits, ",.", "."))
        .when(digits.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.translate(digits, ",", ""))
        .when(digits.rlike(r"^\d+,\d{1,2}$"), F.translate(digits, ",", "."))
        .when(digits.rlike(r"^\d+(\.\d+)?$"), digits)
    )
    return F.struct(
        number.try_cast("decimal(20,6)").alias("value"),
        F.when(currency == "\u20ac", "EUR").when(currency == "\u00a3", "GBP").when(currency == "$", "USD").when(currency != "", currency).alias("currency"),
    )


def money_columns(number: Column, prefix: str, outlier: float) -> list[Column]:
    """The eight money columns of the wide table, from a ``clean_number``."""
    value = number["value"]
    return [
        value.alias(f"{prefix}_eur"),
        number["valid"].cast("int").alias(f"{prefix}_numeric_valid"),
        flag(value > 0).alias(f"{prefix}_positive"),
        F.log1p(value).alias(f"{prefix}_log1p"),
        flag(value > outlier).alias(f"{prefix}_outlier_flag"),
        number["raw"].alias(f"{prefix}_raw"),
        number["status"].alias(f"{prefix}_status"),
        number["error"].alias(f"{prefix}_error"),
    ]


def fine_ratio(fine: Column, turnover: Column) -> Column:
    return F.when(turnover > 0, fine / turnover)


# --- country -----------------------------------------------------------------
def clean_country(c: Column) -> Column:
    """``struct<value, status>``: the text after the last colon of a prefixed code."""
    raw = blank_to_empty(c)
    code = blank_to_empty(F.substring_index(raw, ":", -1))
    value = F.when(F.startswith(raw, F.lit(vocab.COUNTRY_PREFIX)), code).when(raw != "", raw)
    return F.struct(
        value.alias("value"),
        F.when(raw == "", "NOT_MENTIONED").otherwise("DISCUSSED").alias("status"),
    )


def country_columns(country: Column) -> list[Column]:
    """Code, status, group, UK mapping and whitelist flag of a ``clean_country``."""
    upper = F.upper(F.coalesce(country["value"], F.lit("")))
    code = F.when(upper == "UK", "GB").otherwise(upper)
    return [
        code.alias("country_code"),
        country["status"].alias("country_status"),
        country_group(code).alias("country_group"),
        (upper == "UK").cast("int").alias("country_mapped_from_uk"),
        code.isin(*vocab.COUNTRY_WHITELIST).cast("int").alias("country_whitelist_ok"),
    ]


def country_group(code: Column) -> Column:
    upper = F.upper(F.coalesce(code, F.lit("")))
    return (
        F.when(upper == "", "UNKNOWN")
        .when(upper.isin(*vocab.EU_CODES), "EU")
        .when(upper.isin(*vocab.EEA_ONLY_CODES), "EEA_NON_EU")
        .when(upper == "EU", "EU_INSTITUTION")
        .otherwise("NON_EEA")
    )
