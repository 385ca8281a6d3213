"""Derived features: dates, safeguards, ordinals, roll-ups, core tables, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.codebook import Codebook
from caseloom.functions.text import blank_to_empty
from caseloom.functions.tokens import answer_tokens, any_conflict, exclusivity_conflict, multiselect_status
from caseloom.functions.typed import any_of, clean_country, clean_date, clean_number, country_columns, flag
from caseloom.operators.enrich import sector_codes


def _a(q: str) -> Column:
    return F.col("answers")[q]


def _text(q: str) -> Column:
    return F.coalesce(_a(q), F.lit(""))


def substantive(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*vocab.ABSENCE_TOKENS))


def date_features(parsed: DataFrame, as_of: str, id_col: str = "ID", first_year: int = 2018) -> DataFrame:
    """Plausibility, ISO week, month index (months since January ``first_year``) and age in days."""
    day = F.col("day")
    return parsed.select(F.col(id_col).alias("decision_id"), clean_date(_a("Q3"))["value"].alias("day")).select(
        "decision_id",
        day.alias("decision_date"),
        flag(F.year(day) >= first_year).alias("date_plausible"),
        F.weekofyear(day).alias("iso_week"),
        ((F.year(day) - first_year) * 12 + F.month(day) - 1).alias("month_index"),
        F.datediff(F.lit(as_of).cast("date"), day).alias("decision_age_days"),
    )


_MULTI = [q for q, _ in vocab.WIDE_FIELDS]
_BREACH_DETAIL = ("Q20", "Q21", "Q22", "Q23", "Q24", "Q25", "Q28")


def safeguards(parsed: DataFrame, id_col: str = "ID") -> DataFrame:
    """Specification-level warnings, beside (never instead of) the coded statuses."""
    staged = parsed.select(
        F.col(id_col).alias("decision_id"), "answers",
        *[answer_tokens(_a(q)).alias(f"_{q}") for q in ("Q30", "Q31", "Q53")],
        any_conflict(F.col("answers"), _MULTI).alias("_mixed"),
        F.struct(*country_columns(clean_country(_a("Q1")))).alias("_geo"),
    )
    violated = F.array_intersect(F.col("_Q31"), F.lit(list(vocab.PRINCIPLES)))
    unseen = F.array_except(violated, F.col("_Q30"))
    cross = _text("Q49").isin("YES_LEAD_AUTHORITY_CASE", "YES_MULTIPLE_DPAS_INVOLVED") | _text("Q62").isin(
        "LEAD_SUPERVISORY_AUTHORITY_CASE", "CONCERNED_AUTHORITY_CASE", "JOINT_INVESTIGATION"
    )
    in_area = F.col("_geo.country_group").isin("EU", "EEA_NON_EU", "EU_INSTITUTION")
    detail = any_of([F.size(F.filter(substantive(answer_tokens(_a(q))), lambda t: t != "NEITHER")) > 0
                     for q in _BREACH_DETAIL])
    return staged.select(
        "decision_id",
        F.col("_mixed").cast("int").alias("na_conflict_flag"),
        F.when(exclusivity_conflict(F.col("_Q53")) == 1, "MIXED_CONTRADICTORY")
        .otherwise(multiselect_status("Q53", F.col("_Q53"))).alias("powers_audit_status"),
        F.when((_text("Q39") == "HIT_4PCT_TURNOVER_CAP") & (blank_to_empty(_a("Q38")) == ""), 0)
        .otherwise(1).alias("verification_possible"),
        F.array_join(F.array_sort(unseen), ",").alias("violated_not_discussed"),
        flag(cross & ~in_area & (_text("Q62") != "NON_EU_ENTITY_INVOLVED")).alias("cross_border_outside_area"),
        flag((_text("Q16") == "NO") & detail).alias("breach_content_without_breach"),
    )


def turnover_midpoint(c: Column) -> Column:
    """Midpoint of a turnover range; the open top range gives its lower end."""
    table = F.create_map(*[F.lit(x) for pair in vocab.TURNOVER_MIDPOINTS.items() for x in pair])
    return table[F.coalesce(c, F.lit(""))]


def ordinal(question: str, c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in vocab.ORDINALS[question].items() for x in pair])
    return table[F.coalesce(c, F.lit(""))]


def scales(parsed: DataFrame, id_col: str = "ID") -> DataFrame:
    """Imputed turnover and ordinal scales; the categories stay beside them."""
    midpoint = turnover_midpoint(_a("Q14"))
    return parsed.select(
        F.col(id_col).alias("decision_id"),
        _a("Q14").alias("turnover_range"),
        midpoint.alias("turnover_range_midpoint_eur"),
        midpoint.isNotNull().cast("int").alias("range_imputed"),
        _a("Q40").alias("duration"), ordinal("Q40", _a("Q40")).alias("duration_ordinal"),
        _a("Q45").alias("cooperation"), ordinal("Q45", _a("Q45")).alias("cooperation_ordinal"),
        _a("Q55").alias("deadline"), ordinal("Q55", _a("Q55")).alias("deadline_ordinal"),
        _a("Q65").alias("precedent"), ordinal("Q65", _a("Q65")).alias("precedent_ordinal"),
    )


def rollups(parsed: DataFrame, codebook: Codebook | None = None, id_col: str = "ID") -> DataFrame:
    """Counts and flags per decision, without leaving the row."""
    codebook = codebook or Codebook.default()

    def count(q: str) -> Column:
        return F.size(substantive(F.array_distinct(codebook.known(q, answer_tokens(_a(q))))))

    size_class = answer_tokens(_a("Q10"))
    sector = sector_codes(_a("Q12"))["primary"]
    mitigating = F.array_distinct(substantive(answer_tokens(_a("Q28"))))
    size_label = F.coalesce(F.try_element_at(substantive(size_class), F.lit(1)), F.lit("UNKNOWN"))
    return parsed.select(
        F.col(id_col).alias("decision_id"),
        count("Q56").alias("n_rights_discussed"),
        count("Q57").alias("n_rights_violated"),
        count("Q41").alias("n_aggravating"),
        count("Q42").alias("n_mitigating"),
        F.array_contains(size_class, "PUBLIC_SECTOR_BODY").cast("int").alias("public_sector"),
        F.concat(size_label, F.lit("|"), F.coalesce(F.substring(sector, 1, 2), F.lit("UNKNOWN"))).alias("size_sector"),
        F.when(_text("Q4") == "YES", "appeal").otherwise("non_appeal").alias("case_class"),
        flag(_a("Q60") == "YES_REQUIRED_NOT_APPOINTED").alias("dpo_noncompliant"),
        F.when(_text("Q17") != "YES_REQUIRED", "NOT_REQUIRED")
        .when(_text("Q18") == "YES_SUBMITTED",
              F.when(_text("Q19") == "YES_WITHIN_72H", "SUBMITTED_IN_TIME").otherwise("SUBMITTED_NOT_IN_TIME"))
        .otherwise("NOT_SUBMITTED").alias("breach_chain"),
        F.array_contains(answer_tokens(_a("Q25")), "ARTICLE_9_SPECIAL_CATEGORY").cast("int").alias("special_category"),
        F.size(mitigating).alias("n_mitigating_actions"),
    )


def guidelines(parsed: DataFrame, id_col: str = "ID") -> DataFrame:
    """``(decision_id, position, guideline)``: numbers such as ``07/2020`` in Q67."""
    numbers = F.regexp_extract_all(_text("Q67"), F.lit(r"(\d+/\d{4})"), 1)
    return parsed.select(F.col(id_col).alias("decision_id"), F.posexplode(numbers).alias("position", "guideline"))


# Single-valued questions and the column names of the core tables.
DECISION_FIELDS = {"Q4": "appeal", "Q5": "appeal_outcome", "Q15": "initiation", "Q16": "breach_discussed",
                   "Q17": "art33_required", "Q18": "art33_submitted", "Q19": "art33_timeliness", "Q20": "art33_delay",
                   "Q22": "breach_cause", "Q23": "breach_harm", "Q24": "subjects_affected",
                   "Q26": "subjects_notified", "Q27": "art34_required", "Q29": "breach_fine_effect",
                   "Q35": "li_test_outcome", "Q39": "cap_claim", "Q40": "duration", "Q43": "harm",
                   "Q44": "economic_benefit", "Q45": "cooperation", "Q48": "first_time", "Q49": "cross_border",
                   "Q51": "financial_situation", "Q55": "compliance_deadline", "Q60": "dpo_discussed",
                   "Q62": "jurisdiction", "Q63": "transfers", "Q65": "precedent", "Q66": "references"}
DEFENDANT_FIELDS = {"Q6": "multiple_defendants", "Q7": "defendant_name", "Q8": "legal_status", "Q9": "role",
                    "Q10": "classifications", "Q11": "governance_level", "Q12": "sector_raw",
                    "Q13": "turnover_mentioned", "Q14": "turnover_range"}


# --- conflicts, quality, provenance ------------------------------------------
CONFLICT_TYPES = {
    "contradiction": (
        "q17_yes_required_but_q18_not_applicable", "q18_submitted_but_q16_no_breach",
        "q27_yes_required_but_q16_not_yes", "q26_yes_notified_but_q16_no_breach",
        "q60_required_not_appointed_but_q61_missing_no_dpo", "admin_fine_present_but_fine_zero_or_invalid",
        "appeal_outcome_present_but_q4_no", "cap_hit_with_zero_fine",
    ),
    "unverifiable": (
        "turnover_cap_claim_unverifiable_turnover_missing", "cross_border_claim_requires_geo_verification",
    ),
    "parse_error": ("fine_amount_parse_error", "turnover_parse_error"),
    "exclusivity": ("exclusivity_conflict",),
    "date": ("decision_date_parse_error",),
}


def all_flags(parsed: DataFrame, id_col: str = "ID", keep: tuple[str, ...] = ()) -> DataFrame:
    """Consistency flags plus exclusivity and date anomalies, per decision, with the columns ``keep``."""
    from caseloom.functions.flags import consistency_rules, flag_array

    staged = parsed.select(
        F.col(id_col).alias("decision_id"), *keep, "answers", F.col("metadata.completeness").alias("complete"),
        clean_number(_a("Q37")).alias("fine"), clean_number(_a("Q38")).alias("turnover"),
        clean_date(_a("Q3"))["status"].alias("date_status"),
        any_conflict(F.col("answers"), _MULTI).alias("mixed"),
    )
    rules = consistency_rules(_a, F.col("fine"), F.col("turnover")) + [
        ("exclusivity_conflict", F.col("mixed")),
        ("decision_date_parse_error", F.col("date_status") == "PARSE_ERROR"),
    ]
    return staged.select("decision_id", *keep, "complete", flag_array(rules).alias("flags"))


def conflict_matrix(flags: DataFrame) -> DataFrame:
    """Number of conflicts of each type per decision, straight from the flag array."""
    return flags.select(
        "decision_id",
        *[F.size(F.array_intersect("flags", F.lit(list(members)))).alias(kind)
          for kind, members in CONFLICT_TYPES.items()],
    )


def validation_summary(flags: DataFrame) -> DataFrame:
    """``(flag, n)`` over all decisions, with the totals as ``(all)`` and ``(complete)``."""
    marks = F.concat(F.array(F.lit("(all)")), F.when(F.col("complete"), F.array(F.lit("(complete)"))).otherwise(
        F.array().cast("array<string>")), F.col("flags"))
    return flags.select(F.explode(marks).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def quality_score(flags: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """1 minus the weighted conflicts (default 0.1 each) and 0.2 when incomplete, at least 0."""
    weights = weights or {}
    table = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))]) if weights else None

    def weight(f: Column) -> Column:
        return F.coalesce(table[f], F.lit(0.1)) if table is not None else F.lit(0.1)

    penalty = F.aggregate("flags", F.lit(0.0), lambda acc, f: acc + weight(f))
    score = 1 - penalty - F.when(F.col("complete"), 0.0).otherwise(0.2)
    return flags.withColumn("quality_score", F.round(F.greatest(score, F.lit(0.0)), 6))


def strict(flags: DataFrame, tolerate: tuple[str, ...] = ()) -> DataFrame:
    """Opt-in strict mode: complete decisions without flags, but for tolerated ones."""
    serious = F.filter("flags", lambda f: ~f.isin(*tolerate)) if tolerate else F.col("flags")
    return flags.filter(F.col("complete") & (F.size(serious) == 0))


def with_provenance(df: DataFrame, source_id: Column | str, codebook_version: Column | str, mapping_version: str) -> DataFrame:
    """``codebook_version`` may be the column of :func:`caseloom.operators.codebooks.in_force`."""
    source = F.lit(source_id) if isinstance(source_id, str) else source_id
    book = F.lit(codebook_version) if isinstance(codebook_version, str) else codebook_version
    return df.withColumns({
        "source_id": source,
        "ingestion_timestamp": F.current_timestamp(),
        "parser_version": F.lit(vocab.PARSER_VERSION),
        "codebook_version": book,
        "mapping_version": F.lit(mapping_version),
    })
