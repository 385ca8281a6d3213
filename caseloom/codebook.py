"""The codebook: which tokens each question allows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.vocab import ENUM_OPTIONS, MULTI_SELECT_OPTIONS, OPEN_QUESTIONS, OTHER_MULTI_SELECT_OPTIONS

OPTION_KINDS = ("ENUM", "MULTI_SELECT")


class Codebook:
    """Allowed tokens per question, held as literals inside the plan.

    A codebook describes one questionnaire, whatever the number of decisions, so
    the allowed tokens become constant arrays and token validation needs no join.
    :func:`caseloom.operators.tokens.validate_tokens_long` joins against a
    vocabulary given as a DataFrame instead.

    ``kinds`` tells questions with one option from those with several; a question
    with options of which no kind is given takes several.
    """

    def __init__(self, options: Mapping[str, Sequence[str]] | None = None, kinds: Mapping[str, str] | None = None):
        self.options = {q: tuple(v) for q, v in (options or {}).items() if v}
        self.kinds = {q: "MULTI_SELECT" for q in self.options} | dict(kinds or {})

    def multi_selects(self) -> list[str]:
        return [q for q in self.options if self.kinds[q] == "MULTI_SELECT"]

    @classmethod
    def default(cls) -> Codebook:
        """All 68 questions; the 57 of kind ENUM or MULTI_SELECT have options."""
        kinds = OPEN_QUESTIONS | dict.fromkeys([*ENUM_OPTIONS, "Q35"], "ENUM")
        return cls(MULTI_SELECT_OPTIONS | OTHER_MULTI_SELECT_OPTIONS | ENUM_OPTIONS, kinds)

    @classmethod
    def from_frame(cls, frame: DataFrame) -> Codebook:
        """From ``(question, kind, options)`` rows, e.g. :func:`read_codebook`."""
        rows = (
            frame.filter(F.col("kind").isin(*OPTION_KINDS))
            .select("question", "kind", F.posexplode("options").alias("ordinal", "token"))
            .collect()
        )
        options: dict[str, list[str]] = {}
        for row in sorted(rows, key=lambda r: (r.question, r.ordinal)):
            options.setdefault(row.question, []).append(row.token)
        return cls(options, {row.question: row.kind for row in rows})

    def allowed(self, question: str) -> tuple[str, ...]:
        return self.options.get(question, ())

    def is_known(self, question: str, token: Column) -> Column:
        """A question without options accepts every token."""
        allowed = self.allowed(question)
        return token.isin(*allowed) if allowed else F.lit(True)

    def known(self, question: str, tokens: Column) -> Column:
        allowed = self.allowed(question)
        if not allowed:
            return tokens
        vocabulary = F.lit(list(allowed))
        return F.filter(tokens, lambda t: F.array_contains(vocabulary, t))

    def unknown(self, question: str, tokens: Column) -> Column:
        allowed = self.allowed(question)
        if not allowed:
            return F.filter(tokens, lambda t: F.lit(False))
        vocabulary = F.lit(list(allowed))
        return F.filter(tokens, lambda t: ~F.array_contains(vocabulary, t))

    def allowed_for(self, question: Column) -> Column:
        """Allowed tokens of a question given as a column; NULL when it lists none."""
        if not self.options:
            return F.lit(None).cast("array<string>")
        pairs = [x for q, v in self.options.items() for x in (F.lit(q), F.lit(list(v)))]
        return F.create_map(*pairs)[question]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(q, t) for q, v in self.options.items() for t in v]
        return spark.createDataFrame(rows, "question string, token string")
