import math

import pytest
from pyspark.sql import functions as F

from caseloom.functions import typed as ty
from caseloom.functions.text import language_guess, normalize_text, strip, token_count


def run(spark, values, **columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return df.select("i", *[f(F.col("v")).alias(n) for n, f in columns.items()]).orderBy("i").collect()


def test_dates(spark):
    cases = {
        "2023-10-26": "DISCUSSED", "2023-1-5": "DISCUSSED", " 2023-10-26 ": "DISCUSSED", "2023-13-40": "PARSE_ERROR",
        "2023-02-30": "PARSE_ERROR", "2023-01-005": "PARSE_ERROR", "0000-01-01": "PARSE_ERROR", "UNCLEAR": "PARSE_ERROR",
        "FORMAT:YYYY-MM-DD": "PARSE_ERROR", "NOT_DISCUSSED": "NOT_DISCUSSED", "NOT_APPLICABLE": "NOT_APPLICABLE",
        "\u00a0": "NOT_MENTIONED", None: "NOT_MENTIONED", "2023-10-26x": "PARSE_ERROR",
    }
    rows = run(spark, list(cases), d=ty.clean_date)
    assert [r.d.status for r in rows] == list(cases.values())
    assert str(rows[1].d.value) == "2023-01-05" and rows[3].d.error == "invalid_date" and rows[0].d.error is None


@pytest.mark.parametrize("strict", [False])
def test_numbers(spark, strict):
    cases = {
        "1,234.50": (1234.5, "DISCUSSED"), "-5": (None, "NEGATIVE_VALUE"), "": (None, "NOT_MENTIONED"),
        None: (None, "NOT_MENTIONED"), "NONE": (None, "NONE"), "null": (None, "PARSE_ERROR"),
        "5000 EUR": (None, "PARSE_ERROR"), "EUR 5000": (None, "PARSE_ERROR"), "UNCLEAR": (None, "PARSE_ERROR"),
        "5.000": (5.0, "DISCUSSED"), "1,5": (15.0, "DISCUSSED"), "1.234.567,89": (1234.56789, "DISCUSSED"),
        "20 million": (20.0, "DISCUSSED"), "\u20ac 1 000": (1000.0, "DISCUSSED"), "1e3": (1000.0, "DISCUSSED"),
        "1e400": (math.inf, "DISCUSSED"), "\u20ac": (None, "PARSE_ERROR"), "5.": (5.0, "DISCUSSED"), ".5": (0.5, "DISCUSSED"),
        "-0": (0.0, "DISCUSSED"), "NOT_DISCUSSED": (None, "NOT_DISCUSSED"), ".": (None, "PARSE_ERROR"),
    }
    rows = run(spark, list(cases), n=ty.clean_number)
    assert [(r.n.value, r.n.status) for r in rows] == list(cases.values())
    errors = dict(zip(cases, [r.n.error for r in rows], strict=True))
    assert errors["\u20ac"] == "sanitized_numeric_string_empty" and errors["-5"] == "value_lt_zero"
    assert errors["null"] == "sanitized_numeric_string_empty" and errors["EUR 5000"] == "invalid_number"
    assert [r.n.valid for r in rows][:4] == [True, False, True, True]


def test_strict_money(spark):
    rows = run(spark, ["1.234.567,89 EUR", "EUR 5000", "14,931 RON", "\u20ac1,5", "n/a", "12 apples", None], m=ty.strict_money)
    got = [(None if r.m.value is None else float(r.m.value), r.m.currency) for r in rows]
    assert got[:4] == [(1234567.89, "EUR"), (5000.0, "EUR"), (14931.0, "RON"), (1.5, "EUR")]
    assert all(v is None for v, _ in got[4:])


def test_money_columns(spark):
    df = spark.createDataFrame([("20000000000", "5"), ("0", None), ("x", "0")], "f string, t string")
    f, t = ty.clean_number(F.col("f")), ty.clean_number(F.col("t"))
    rows = df.select(*ty.money_columns(f, "fine", 1e10), ty.fine_ratio(f["value"], t["value"]).alias("ratio")).collect()
    assert rows[0].fine_outlier_flag == 1 and rows[0].fine_positive == 1 and rows[0].ratio == 4e9
    assert rows[1].fine_log1p == 0.0 and rows[1].fine_positive == 0 and rows[1].ratio is None
    assert rows[2].fine_eur is None and rows[2].fine_numeric_valid == 0 and rows[2].ratio is None


def test_country(spark):
    values = ["ISO_3166-1_ALPHA-2: FR", "uk", "ISO_3166-1_ALPHA-2: EU", "IS", "UNCLEAR", None, "ISO_3166-1_ALPHA-2:", "US"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", ty.clean_country(F.col("v")).alias("c")).select("i", *ty.country_columns(F.col("c"))).orderBy("i").collect()
    got = [(r.country_code, r.country_status, r.country_group, r.country_mapped_from_uk, r.country_whitelist_ok) for r in rows]
    assert got == [
        ("FR", "DISCUSSED", "EU", 0, 1), ("GB", "DISCUSSED", "NON_EEA", 1, 0), ("EU", "DISCUSSED", "EU_INSTITUTION", 0, 1),
        ("IS", "DISCUSSED", "EEA_NON_EU", 0, 1), ("UNCLEAR", "DISCUSSED", "NON_EEA", 0, 1), ("", "NOT_MENTIONED", "UNKNOWN", 0, 0),
        ("", "DISCUSSED", "UNKNOWN", 0, 0), ("US", "DISCUSSED", "NON_EEA", 0, 0),
    ]


def test_schema_echo(spark):
    rows = run(spark, [" TYPE:STRING", "ENUM:A", "MULTI_SELECT:A", "FORMAT:X", "x TYPE:", None], e=ty.is_schema_echo)
    assert [r.e for r in rows] == [True, True, True, False, False, False]


def test_text(spark):
    values = ["  cafe\u0301 \u00a0 \u200bbar\ufeff ", "", None, "abc", "\u0440\u0435\u0448", "\u212b x", "a\x1cb"]
    rows = run(spark, values, t=normalize_text, n=lambda c: token_count(normalize_text(c)),
               lang=lambda c: language_guess(normalize_text(c)), s=strip)
    assert [r.t for r in rows] == ["caf\u00e9 bar", "", "", "abc", "\u0440\u0435\u0448", "\u00c5 x", "a b"]
    assert [r.n for r in rows] == [2, 0, 0, 1, 1, 2, 2]
    assert [r.lang for r in rows] == ["UNKNOWN", "UNKNOWN", "UNKNOWN", "ENGLISH_LIKELY", "UNKNOWN", "UNKNOWN", "ENGLISH_LIKELY"]
