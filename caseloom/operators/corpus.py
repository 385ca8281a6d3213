"""Markdown decision documents: header fields, sections, duplicates, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import strip
from caseloom.functions.typed import strict_money

_HEADER_LINE = r"(?m)^\*\*([^*\n]+):\*\*[ \t]*(.*)$"
# column, heading line, and whether the section runs to the end of the document
SECTIONS = (
    ("facts", "\n### Facts\n", False),
    ("holding", "\n### Holding\n", False),
    ("comment", "\n## Comment\n", False),
    ("machine_translation", "\n## English Machine Translation of the Decision\n", True),
)


def header_part(text: Column) -> Column:
    return F.substring_index(text, "\n## Contents", 1)


def header_fields(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``header``: ``map<field, value>`` from the ``**Field:** value`` lines.

    Only the part before the contents list is searched; the last of a repeated
    field counts.
    """
    top = header_part(F.col(text_col))
    found = df.withColumns({
        "_k": F.regexp_extract_all(top, F.lit(_HEADER_LINE), 1),
        "_v": F.transform(F.regexp_extract_all(top, F.lit(_HEADER_LINE), 2), strip),
    })
    pairs = F.filter(
        F.arrays_zip(F.col("_k").alias("key"), F.col("_v").alias("value")),
        lambda e, i: ~F.array_contains(F.slice("_k", i + 2, F.size("_k")), e["key"]),
    )
    return found.withColumn("header", F.map_from_entries(pairs)).drop("_k", "_v")


def _section(text: Column, heading: str, to_end: bool) -> Column:
    at = F.locate(heading, text)
    body = F.substring(text, at + len(heading), F.length(text))
    if not to_end:
        body = F.substring_index(F.substring_index(body, "\n## ", 1), "\n### ", 1)
    return F.when(at > 0, strip(body))


def sections(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One column per section; NULL where the heading is missing."""
    return df.withColumns({name: _section(F.col(text_col), h, end) for name, h, end in SECTIONS})


def is_decision(text: Column) -> Column:
    """Whether the part before the contents names a jurisdiction; copies of wiki pages don't."""
    return F.rlike(header_part(text), F.lit(r"(?m)^\*\*Jurisdiction:\*\*"))


def drop_non_decisions(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.filter(is_decision(F.col(text_col)))


def drop_exact_duplicates(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Keep of every text the rows with its smallest id.

    Digests and ids are grouped, the minimum being taken map-side first.  Only
    the (digest, id) pairs of further copies, few next to all, then leave by an
    anti-join, so an id that also names another text keeps that one, and texts
    stay where they are unless the copies are too many to broadcast.  A NULL text
    is no copy of another, and a NULL id comes after all others.
    """
    digest = F.sha2(F.col(text_col), 256)
    named = df.select(digest.alias("_digest"), F.col(id_col).alias("_id")).filter("_digest IS NOT NULL")
    again = named.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    further = named.join(again, "_digest").filter(~F.col("_id").eqNullSafe(F.col("_first"))).select("_digest", "_id").distinct()
    marked = df.withColumn("_text_digest", digest)
    gone = (F.col("_text_digest") == F.col("_digest")) & F.col(id_col).eqNullSafe(F.col("_id"))
    return marked.join(further, gone, "left_anti").drop("_text_digest")


def cited_articles(df: DataFrame, id_col: str, field: str = "Relevant Law") -> DataFrame:
    """``(id, position, article)``; citations may run together in the header."""
    found = F.regexp_extract_all(F.col("header")[field], F.lit(r"Article \d+(\([^)]*\))*"), 0)
    return df.select(id_col, F.posexplode(found).alias("position", "article"))


def corpus_date(c: Column) -> Column:
    """Dates such as ``07.10.2022``, ``5. 2. 2020``, ``20.07.23`` or ``20/12/2022``."""
    shape = r"^(\d{1,2})[./]\s*(\d{1,2})[./]\s*(\d{4}|\d{2})$"
    text = strip(c)
    year = F.regexp_extract(text, shape, 3)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    plain = F.concat_ws("-", full, F.regexp_extract(text, shape, 2), F.regexp_extract(text, shape, 1))
    return F.when(text.rlike(shape), F.try_to_date(plain, "yyyy-M-d"))


def corpus_columns(df: DataFrame) -> DataFrame:
    """Typed header values: dates, fine amount and currency, nothing converted."""
    h = F.col("header")
    money = strict_money(h["Fine"])
    return df.withColumns({
        "started": corpus_date(h["Started"]),
        "decided": corpus_date(h["Decided"]),
        "published": corpus_date(h["Published"]),
        "fine_amount": money["value"],
        "fine_currency": F.when(money["value"].isNotNull(), money["currency"]),
    })
