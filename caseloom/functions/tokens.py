"""Array helpers for multi-select answers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.functions.text import strip
from caseloom.functions.typed import any_of, flag


def split_tokens(c: Column) -> Column:
    """Split on commas, trim, drop empties; order and duplicates are kept."""
    # a one-character separator needs no pattern to be compiled per row
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    return F.array_remove(parts, "")


def drop_echo_tokens(tokens: Column) -> Column:
    def echo(t: Column) -> Column:
        return any_of([F.startswith(t, F.lit(p)) for p in vocab.ECHO_PREFIXES])

    return F.filter(tokens, lambda t: ~echo(t))


def answer_tokens(c: Column) -> Column:
    tokens = split_tokens(c)
    return F.when(F.contains(c, F.lit(":")), drop_echo_tokens(tokens)).otherwise(tokens)


def _only(tokens: Column, marker: str) -> Column:
    """Every token of a non-empty list is ``marker``."""
    return F.size(F.array_remove(tokens, marker)) == 0


def multiselect_status(question: Column | str, tokens: Column) -> Column:
    """Status of an answer from its tokens; ``question`` may be a column."""
    q = F.lit(question) if isinstance(question, str) else question
    verdict = q.isin("Q31", "Q57")
    return (
        F.when(F.size(tokens) == 0, "NOT_MENTIONED")
        .when(verdict & F.array_contains(tokens, "NONE_VIOLATED"), "NONE_VIOLATED")
        .when(verdict & F.array_contains(tokens, "NOT_DETERMINED"), "NOT_DETERMINED")
        .when(_only(tokens, "NOT_APPLICABLE"), "NOT_APPLICABLE")
        .when(_only(tokens, "NONE_MENTIONED"), "NONE_MENTIONED")
        .when((q == "Q30") & _only(tokens, "NONE_DISCUSSED"), "NONE_DISCUSSED")
        .otherwise("DISCUSSED")
    )


def exclusivity_conflict(tokens: Column) -> Column:
    """1 when an exclusive marker stands beside a substantive token."""
    marker = F.exists(tokens, lambda t: t.isin(*vocab.EXCLUSIVE_MARKERS))
    other = F.exists(tokens, lambda t: ~t.isin(*vocab.EXCLUSIVE_MARKERS))
    return flag(marker & other)


def principles_discussed(known: Column) -> Column:
    return F.size(known)


def principles_violated(known: Column) -> Column:
    found = F.filter(known, lambda t: ~F.startswith(t, F.lit("NONE_")) & (t != "NOT_DETERMINED"))
    return F.size(found)


def corrective_measures(known: Column) -> Column:
    return F.size(F.array_remove(known, "NONE"))


def severity_present(known: Column) -> Column:
    return flag(F.arrays_overlap(known, F.lit(list(vocab.SEVERITY_MEASURES))))


def remedy_only(known: Column, fine: Column) -> Column:
    other = F.array_except(known, F.lit(["NONE", "ADMINISTRATIVE_FINE"]))
    return flag((F.coalesce(fine, F.lit(0.0)) == 0) & (F.size(other) > 0))


def answer_list(answers: Column, questions: list[str]) -> Column:
    """``array<struct<question, answer>>``: one set of expressions then serves all questions.

    The lookups are a loop: written out, they make a generated method too long to be compiled.
    """
    return F.transform(F.lit(list(questions)), lambda q: F.struct(q.alias("question"), answers[q].alias("answer")))


def answer_columns(parsed: DataFrame, questions: Mapping[str, str], *keep: Column | str) -> DataFrame:
    """The columns of ``keep`` and one column per answer; ``questions`` maps their names to questions.

    The answers leave through a one-element explode, so that the loop runs once per row.
    """
    found = F.transform(F.lit(list(questions.values())), lambda q: F.col("answers")[q])
    staged = parsed.select(*keep, F.explode(F.array(found)).alias("_found"))
    kept = [c for c in staged.columns if c != "_found"]
    return staged.select(*kept, *[F.col("_found")[i].alias(name) for i, name in enumerate(questions)])


def any_conflict(answers: Column, questions: list[str]) -> Column:
    """True when one of the answers mixes an exclusive marker with other tokens."""
    cells = answer_list(answers, questions)
    return F.exists(F.transform(cells, lambda c: answer_tokens(c["answer"])), lambda t: exclusivity_conflict(t) == 1)
