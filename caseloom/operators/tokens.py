"""Token validation against a codebook held as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.tokens import answer_tokens


def question_tokens(parsed: DataFrame, questions: list[str], id_col: str = "ID") -> DataFrame:
    """``(decision_id, question, position, token)`` for the given questions."""
    # the map is walked once; looking up each question would walk it once per question
    said = parsed.select(F.col(id_col).alias("decision_id"), F.explode("answers").alias("question", "_a")).filter(
        F.col("question").isin(questions) & F.col("_a").isNotNull())
    return said.select("decision_id", "question", F.posexplode(answer_tokens(F.col("_a"))).alias("position", "token"))


def token_totals(parsed: DataFrame, questions: list[str]) -> DataFrame:
    """``(question, token, n)`` over all decisions.

    Equal answers are counted before they are split, so tokens are cut once per
    distinct answer and not once per decision.
    """
    said = parsed.select(F.explode("answers").alias("question", "a")).filter(F.col("question").isin(questions) & F.col("a").isNotNull())
    distinct = said.groupBy("question", "a").agg(F.count("*").alias("_n"))
    return distinct.select("question", F.explode(answer_tokens(F.col("a"))).alias("token"), "_n").groupBy("question", "token").agg(F.sum("_n").alias("n"))


def validate_tokens_long(tokens: DataFrame, codebook: DataFrame) -> DataFrame:
    """Adds ``token_status`` by a join with ``codebook(question, token)``.

    A question the codebook does not list accepts every token.
    """
    allowed = codebook.select("question", "token").distinct().withColumn("_known", F.lit(True))
    listed = codebook.select("question").distinct().withColumn("_listed", F.lit(True))
    joined = tokens.join(allowed, ["question", "token"], "left").join(listed, "question", "left")
    known = F.col("_known").isNotNull() | F.col("_listed").isNull()
    return joined.withColumn("token_status", F.when(known, "KNOWN").otherwise("UNKNOWN")).drop("_known", "_listed")


def known_tokens(tokens: DataFrame, codebook: DataFrame) -> DataFrame:
    return tokens.join(codebook.select("question", "token").distinct(), ["question", "token"], "left_semi")


def unknown_tokens(tokens: DataFrame, codebook: DataFrame) -> DataFrame:
    """Tokens of listed questions that the codebook does not allow."""
    listed = codebook.select("question").distinct()
    allowed = codebook.select("question", "token").distinct()
    return tokens.join(listed, "question", "left_semi").join(allowed, ["question", "token"], "left_anti")


def harmonize_token(token: Column) -> Column:
    """Upper snake case form of a token, for vocabularies written that way."""
    return F.upper(F.regexp_replace(token, r"[\s-]+", "_"))


def harmonized_tokens(tokens: DataFrame, codebook: DataFrame) -> DataFrame:
    """Validates the harmonised form; the raw token stays beside it.

    ``FORMAT:`` echoes are dropped here as well.
    """
    kept = tokens.filter(~F.startswith("token", F.lit("FORMAT:")))
    forms = kept.withColumnRenamed("token", "raw_token").withColumn("token", harmonize_token(F.col("raw_token")))
    checked = validate_tokens_long(forms, codebook)
    return checked.withColumn("validation_error", (F.col("token_status") == "UNKNOWN").cast("int"))
