"""The wide table (one row per decision) and its validation report."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.codebook import Codebook
from caseloom.functions import cells
from caseloom.functions import tokens as tk
from caseloom.functions import typed as ty
from caseloom.functions.text import blank_to_empty, language_guess, normalize_text, strip, token_count
from caseloom.operators.enrich import sector_lookup

_NUMBERS = (("fine", "Q37", vocab.FINE_OUTLIER), ("turnover", "Q38", vocab.TURNOVER_OUTLIER))


def answer(question: str) -> Column:
    return F.col("answers")[question]


def ingest_columns() -> list[Column]:
    meta = F.col("metadata")
    return [
        meta["parser_version"].alias("ingest_parser_version"),
        meta["line_count"].alias("ingest_line_count"),
        meta["question_count"].alias("ingest_question_count"),
        F.array_join(meta["missing_questions"], ";").alias("ingest_missing_questions"),
        F.size(meta["warnings"]).alias("ingest_warning_count"),
        F.array_join(meta["warnings"], ";").alias("ingest_warnings"),
    ]


def date_columns(date: Column) -> list[Column]:
    return [
        date["raw"].alias("decision_date_raw"),
        date["value"].alias("decision_date"),
        date["status"].alias("decision_date_status"),
        date["error"].alias("decision_date_error"),
        F.year(date["value"]).alias("decision_year"),
        ty.quarter_label(date["value"]).alias("decision_quarter"),
    ]


def authority_columns(raw: Column) -> list[Column]:
    name = blank_to_empty(raw)
    return [
        name.alias("dpa_name_raw"),
        F.when(ty.is_schema_echo(name), "").otherwise(name).alias("dpa_name_canonical"),
    ]


def echo_columns(authority: Column, sector: Column) -> list[Column]:
    hits = F.array(
        F.when(ty.is_schema_echo(authority), "Q2"),
        F.when(ty.is_schema_echo(sector), "Q12"),
    )
    fields = F.array_join(F.array_sort(F.array_compact(hits)), ";")
    return [(fields != "").cast("int").alias("schema_echo_flag"), fields.alias("schema_echo_fields")]


def text_columns(normalized: Column, prefix: str) -> list[Column]:
    return [
        normalized.alias(f"{prefix}_text"),
        language_guess(normalized).alias(f"{prefix}_lang"),
        token_count(normalized).alias(f"{prefix}_tokens"),
    ]


def multiselect_fields(answers: Column, questions: list[str], codebook: Codebook) -> Column:
    """``array<struct<known, unknown, status, conflict>>`` in question order; the tokens are joined by commas."""
    # local functions travel by value: executors need not import this package
    read, statuses, conflicts = (f(questions, codebook) for f in (cells.token_reader, cells.status_reader, cells.conflict_reader))
    names, width = cells.STATUSES, len(questions)

    def joined(tokens, cell, keep, count):
        ends = np.concatenate([[0], np.cumsum(np.bincount(cell[keep], minlength=count))]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens.filter(pa.array(keep))), ",").cast(pa.string())

    def fields(rows: pa.Array) -> pa.Array:
        texts = pc.list_flatten(rows)
        question = np.tile(np.arange(width), len(rows))
        tokens, cell, listed, known, _ = read(texts, question)
        count = len(texts)
        status = pa.array(names).take(pa.array(statuses(cell, listed, question)))
        found = pa.StructArray.from_arrays(
            [joined(tokens, cell, known, count), joined(tokens, cell, ~known, count), status, pa.array(conflicts(cell, listed, count))],
            ["known", "unknown", "status", "conflict"])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, count + 1, width, dtype=np.int32)), found)

    listed_answers = F.transform(F.lit(list(questions)), lambda q: answers[q])
    return F.arrow_udf(fields, "array<struct<known: string, unknown: string, status: string, conflict: int>>")(listed_answers)


def multiselect_columns(field: Column, prefix: str) -> list[Column]:
    return [
        field["known"].alias(f"{prefix}_known"),
        field["unknown"].alias(f"{prefix}_unknown"),
        field["status"].alias(f"{prefix}_status"),
        field["conflict"].alias(f"{prefix}_exclusivity_conflict"),
    ]


def joined_tokens(c: Column) -> Column:
    """The tokens that :func:`multiselect_fields` joined."""
    return F.array_remove(F.split(c, ","), "")


def measure_columns(q30: Column, q31: Column, q53: Column, fine: Column) -> list[Column]:
    """Counts and flags from the *known* tokens of Q30, Q31 and Q53."""
    return [
        tk.principles_discussed(q30).alias("n_principles_discussed"),
        tk.principles_violated(q31).alias("n_principles_violated"),
        tk.corrective_measures(q53).alias("n_corrective_measures"),
        tk.severity_present(q53).alias("severity_measures_present"),
        tk.remedy_only(q53, fine).alias("remedy_only_case"),
    ]


def base_column_names() -> list[str]:
    names = ["decision_id"]
    names += [f"ingest_{c}" for c in ("parser_version", "line_count", "question_count",
                                      "missing_questions", "warning_count", "warnings")]
    names += ["country_code", "country_status", "country_group", "country_mapped_from_uk",
              "country_whitelist_ok", "dpa_name_raw", "dpa_name_canonical"]
    names += ["decision_date_raw", "decision_date", "decision_date_status", "decision_date_error",
              "decision_year", "decision_quarter"]
    for prefix, _, _ in _NUMBERS:
        names += [f"{prefix}_{c}" for c in ("eur", "numeric_valid", "positive", "log1p",
                                            "outlier_flag", "raw", "status", "error")]
    names += ["fine_to_turnover_ratio", "isic_code", "isic_desc", "isic_section"]
    names += ["n_principles_discussed", "n_principles_violated", "n_corrective_measures",
              "severity_measures_present", "remedy_only_case", "breach_case"]
    names += [f"{q.lower()}_{c}" for q in vocab.TEXT_QUESTIONS for c in ("text", "lang", "tokens")]
    return names + ["schema_echo_flag", "schema_echo_fields"]


def multiselect_column_names() -> list[str]:
    parts = ("known", "unknown", "status", "exclusivity_conflict")
    return [f"{prefix}_{part}" for _, prefix in vocab.WIDE_FIELDS for part in parts]


WIDE_COLUMNS = base_column_names() + multiselect_column_names()


def clean_wide(
    parsed: DataFrame,
    codebook: Codebook | None = None,
    sectors: DataFrame | None = None,
    id_col: str = "ID",
) -> DataFrame:
    """124 typed columns per decision; narrow but for the sector lookup.

    Intermediate values (typed structs, multi-select fields, normalised texts)
    are columns of a first select so that each is computed once and shared.
    """
    codebook = codebook or Codebook.default()
    questions = [q for q, _ in vocab.WIDE_FIELDS]
    staged = parsed.select(
        F.col(id_col).alias("decision_id"),
        "metadata",
        ty.clean_country(answer("Q1")).alias("_country"),
        ty.clean_date(answer("Q3")).alias("_date"),
        *[ty.clean_number(answer(q)).alias(f"_{p}") for p, q, _ in _NUMBERS],
        blank_to_empty(answer("Q2")).alias("_authority"),
        blank_to_empty(answer("Q12")).alias("_sector"),
        answer("Q16").eqNullSafe("YES").cast("int").alias("breach_case"),
        *[normalize_text(answer(q)).alias(f"_text_{q}") for q in vocab.TEXT_QUESTIONS],
        multiselect_fields(F.col("answers"), questions, codebook).alias("_fields"),
    )
    field = {q: F.col("_fields")[i] for i, q in enumerate(questions)}
    sector = F.when(ty.is_schema_echo(F.col("_sector")), "").otherwise(F.col("_sector"))
    wide = staged.select(
        "decision_id",
        *ingest_columns(),
        *ty.country_columns(F.col("_country")),
        *authority_columns(F.col("_authority")),
        *date_columns(F.col("_date")),
        *[c for p, _, limit in _NUMBERS for c in ty.money_columns(F.col(f"_{p}"), p, limit)],
        ty.fine_ratio(F.col("_fine.value"), F.col("_turnover.value")).alias("fine_to_turnover_ratio"),
        sector.alias("_raw_sector"),
        *measure_columns(*[joined_tokens(field[q]["known"]) for q in ("Q30", "Q31", "Q53")], F.col("_fine.value")),
        "breach_case",
        *[c for q in vocab.TEXT_QUESTIONS for c in text_columns(F.col(f"_text_{q}"), q.lower())],
        *echo_columns(F.col("_authority"), F.col("_sector")),
        *[c for q, p in vocab.WIDE_FIELDS for c in multiselect_columns(field[q], p)],
    )
    if sectors is None:
        wide = wide.withColumns({
            "isic_code": strip(F.col("_raw_sector")), "isic_desc": F.lit(""), "isic_section": F.lit(""),
        })
    else:
        wide = sector_lookup(wide, sectors, "_raw_sector")
    return wide.select(*WIDE_COLUMNS)


def validation_flags(q53: Column, fine: Column, turnover: Column) -> Column:
    """Flags of the validation report; ``fine``/``turnover`` are clean numbers."""
    named = F.contains(F.coalesce(q53, F.lit("")), F.lit("ADMINISTRATIVE_FINE"))
    checks = F.array(
        F.when(named & ~(F.coalesce(fine["value"], F.lit(0.0)) > 0), "admin_fine_but_zero_amount"),
        F.when(fine["status"] == "PARSE_ERROR", "fine_parse_error"),
        F.when(turnover["status"] == "PARSE_ERROR", "turnover_parse_error"),
    )
    return F.array_compact(checks)


def validate(parsed: DataFrame, id_col: str = "ID") -> DataFrame:
    """``(decision_id, flags)`` for every decision, flagged or not."""
    staged = parsed.select(
        F.col(id_col).alias("decision_id"),
        answer("Q53").alias("q53"),
        ty.clean_number(answer("Q37")).alias("fine"),
        ty.clean_number(answer("Q38")).alias("turnover"),
    )
    return staged.select(
        "decision_id",
        validation_flags(F.col("q53"), F.col("fine"), F.col("turnover")).alias("flags"),
    )
