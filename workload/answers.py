"""Answer blocks derived from the supplied tables.

Each order becomes one coded decision.  The answers are SQL expressions over
``base`` (one row per order) that Spark and DuckDB both evaluate: Spark builds
the answer *text* from them and cleans that text, the oracle starts from the
answer *values* and never parses text, so the parser is checked independently.

``base`` columns: ``k`` order key, ``n`` nation key, ``cents`` price in cents,
``day`` order date, ``prio`` order priority.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.vocab import MULTI_SELECT_OPTIONS, TURNOVER_MIDPOINTS

COUNTRY_CODES = "AT BE BG HR CY CZ DK EE FI FR DE GR HU IE IT LV PT ES SE IS NO EU UK US UNCLEAR".split()

BASE_SQL = """
SELECT o.o_orderkey AS k, c.c_nationkey AS n,
       CAST(round(o.o_totalprice * 100) AS BIGINT) AS cents,
       CAST(o.o_orderdate AS DATE) AS day, o.o_orderpriority AS prio
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
"""


def cycle(values, number: str) -> str:
    """The ``number``-th value, round and round; None gives NULL.

    Both engines fold the split of the literal, so a row costs one index.
    """
    listed = "|".join("~" if v is None else v for v in values)
    return f"NULLIF(split_part('{listed}', '|', CAST(({number}) % {len(values)} + 1 AS INT)), '~')"


def text_of(number: str) -> str:
    return f"CAST({number} AS STRING)"


def multi(question: str) -> str:
    """Token lists with unknown, repeated, echoed and exclusive tokens mixed in."""
    q = int(question[1:])
    options = MULTI_SELECT_OPTIONS[question]
    rng = random.Random(q)
    echo = f"MULTI_SELECT:{options[0]}"
    values = [None, "NOT_APPLICABLE", options[-1], "NONE_MENTIONED,,NONE_MENTIONED", echo,
              f"{echo}, {options[1]},{options[2]}", f"{options[0]}, NOT_APPLICABLE", "NOT_DETERMINED"]
    while len(values) < (23, 29, 31, 37)[q % 4]:
        tokens = rng.sample(options[:-1], rng.randint(1, min(4, len(options) - 1)))
        if rng.random() < 0.2:
            tokens.append(f"Made_up_{rng.randint(1, 6)}")
        if rng.random() < 0.1:
            tokens.append(tokens[0])
        values.append(rng.choice([",", ", "]).join(tokens))
    return cycle(values, f"k + {q}")


_CODE = cycle(COUNTRY_CODES, "n")
_WHOLE = text_of("CAST(floor(cents / 100) AS BIGINT)")
_CENTS = f"lpad({text_of('cents % 100')}, 2, '0')"
_PLAIN = f"({_WHOLE} || '.' || {_CENTS})"
_MILLIONS = text_of("cents % 900 + 1")

ANSWERS: dict[int, str] = {i: cycle(["ALPHA", "BETA", "GAMMA", None], f"k + {i}") for i in range(1, 69)}
ANSWERS[6] = cycle(["YES", "NO"], "k")
ANSWERS[45] = cycle(
    ["FULL_COOPERATION", "PARTIAL_COOPERATION", "NON_COOPERATIVE", "OBSTRUCTIVE", "NOT_DISCUSSED"], "k"
)
ANSWERS.update({
    1: f"CASE WHEN k % 23 = 5 THEN NULL WHEN k % 11 = 1 THEN {_CODE}"
       f" WHEN k % 13 = 0 THEN 'ISO_3166-1_ALPHA-2:  ' || lower({_CODE})"
       f" ELSE 'ISO_3166-1_ALPHA-2: ' || {_CODE} END",
    2: "CASE WHEN k % 31 = 5 THEN NULL WHEN k % 19 = 4 THEN 'TYPE:STRING'"
       f" WHEN k % 17 = 3 THEN 'Data Protecton Ofice No ' || {text_of('n')}"
       f" WHEN k % 29 = 6 THEN 'Unlisted Bureau ' || {text_of('k % 5')}"
       f" WHEN k % 7 = 2 THEN 'DATA PROTECTION OFFICE No ' || {text_of('n')}"
       f" ELSE 'Data Protection Office No ' || {text_of('n')} END",
    3: "CASE k % 9 WHEN 1 THEN 'NOT_DISCUSSED' WHEN 2 THEN 'FORMAT:YYYY-MM-DD' WHEN 3 THEN '2023-13-40'"
       f" WHEN 4 THEN {text_of('year(day)')} || '-' || {text_of('month(day)')} || '-' || {text_of('day(day)')}"
       f" WHEN 5 THEN (CASE WHEN k % 2 = 0 THEN '2023-01-005' ELSE NULL END) ELSE {text_of('day')} END",
    4: cycle(["YES", "NO", "NO", "UNCLEAR", "NOT_DISCUSSED"], "k"),
    5: cycle(["UPHELD", "NOT_APPLICABLE", "OVERTURNED", None, "NOT_APPLICABLE", "NOT_DISCUSSED", "MODIFIED"], "k"),
    7: f"'Defendant ' || {text_of('k % 1000')}",
    9: cycle(["CONTROLLER", "PROCESSOR", "JOINT_CONTROLLER", "NOT_MENTIONED"], "k + 1"),
    10: cycle(["SME", "LARGE_ENTERPRISE", "PUBLIC_SECTOR_BODY", "MULTINATIONAL, LARGE_ENTERPRISE",
               "NON_PROFIT", "NOT_MENTIONED", None], "k"),
    12: "CASE WHEN k % 19 = 7 THEN 'TYPE:STRING' WHEN k % 37 = 3 THEN NULL"
        f" WHEN k % 5 = 1 THEN lpad({text_of('k % 100')}, 2, '0')"
        f" WHEN k % 43 = 2 THEN lpad({text_of('k % 10000')}, 4, '0') || '; ' || lpad({text_of('k % 977')}, 4, '0')"
        f" WHEN k % 11 = 3 THEN chr(CAST(65 + k % 26 AS INT))"
        f" ELSE lpad({text_of('k % 10000')}, 4, '0') END",
    14: cycle([*TURNOVER_MIDPOINTS, "NOT_APPLICABLE", "FIGURE_UNCLEAR", None], "k"),
    16: cycle(["YES", "NO", "UNCLEAR", "YES", None], "k"),
    17: cycle(["YES_REQUIRED", "NO_NOT_REQUIRED", "YES_REQUIRED", "NOT_APPLICABLE", "NOT_MENTIONED"], "k + 2"),
    18: cycle(["YES_SUBMITTED", "NOT_APPLICABLE", "NO_NOT_SUBMITTED", None], "k"),
    19: cycle(["YES_WITHIN_72H", "NO_LATE", "TIMING_DISPUTED", "NOT_APPLICABLE"], "k"),
    25: cycle(["ARTICLE_9_SPECIAL_CATEGORY", "NOT_APPLICABLE", "NEITHER",
               "ARTICLE_9_SPECIAL_CATEGORY, ARTICLE_10_CRIMINAL", None], "k + 1"),
    26: cycle(["YES_NOTIFIED", "NO_NOT_NOTIFIED", "NOT_MENTIONED"], "k + 1"),
    27: cycle(["YES_REQUIRED", "NO_NOT_REQUIRED", "NOT_APPLICABLE"], "k + 2"),
    28: cycle(["SYSTEM_FIXES, STAFF_TRAINING, STAFF_TRAINING", "NONE_MENTIONED", "LEGAL_ADVICE", None], "k"),
    35: cycle([*MULTI_SELECT_OPTIONS["Q35"], "ENUM:NOT_APPLICABLE", "Balanced, somehow", None], "k"),
    36: f"CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'cafe\u0301 \u00a0 finding  no ' || {text_of('k % 50')}"
        f" WHEN 2 THEN 'Zero\u200bwidth\ufeff ' || prio ELSE 'Order ' || prio || '  reviewed in full' END",
    37: "CASE k % 17 WHEN 0 THEN '0' WHEN 1 THEN 'NONE' WHEN 2 THEN '-5' WHEN 3 THEN 'null'"
        f" WHEN 4 THEN {_WHOLE} || ' EUR' WHEN 5 THEN 'EUR ' || {_WHOLE}"
        f" WHEN 6 THEN '1.234.' || lpad({text_of('k % 1000')}, 3, '0') || ',89'"
        f" WHEN 7 THEN {text_of('k % 90 + 1')} || ' million' WHEN 8 THEN '1,5' WHEN 9 THEN NULL"
        f" WHEN 10 THEN '1e' || {text_of('k % 12')} WHEN 11 THEN '\u20ac 1 ' || lpad({text_of('k % 1000')}, 3, '0')"
        f" WHEN 12 THEN 'NOT_DISCUSSED' WHEN 13 THEN '\u20ac'"
        f" ELSE {_PLAIN} END",
    38: f"CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'NOT_MENTIONED' WHEN 2 THEN 'null'"
        f" WHEN 3 THEN {_MILLIONS} || ',000,000' WHEN 4 THEN {_MILLIONS} || '000000000.50'"
        f" WHEN 5 THEN '5.000' ELSE '0' END",
    39: cycle(["HIT_4PCT_TURNOVER_CAP", "HIT_20M_ADMIN_CAP", "BELOW_ALL_CAPS", None, "NOT_APPLICABLE"], "k"),
    43: cycle(["YES_MATERIAL_HARM", "YES_NON_MATERIAL_HARM", "YES_BOTH_TYPES", "NO_HARM_DOCUMENTED"], "k"),
    44: cycle(["YES_QUANTIFIED", "YES_MENTIONED_UNQUANTIFIED", "NO_BENEFIT", "NOT_DISCUSSED"], "k"),
    49: cycle(["YES_LEAD_AUTHORITY_CASE", "NO_SINGLE_JURISDICTION", "YES_MULTIPLE_DPAS_INVOLVED",
               "NOT_DISCUSSED", None, "NO_SINGLE_JURISDICTION"], "k"),
    52: f"CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '\u0440\u0435\u0448\u0435\u043d\u0438\u0435 ' || prio"
        f" ELSE 'Fine set by gravity.  Amount ' || {_WHOLE} || '.' END",
    55: cycle(["IMMEDIATE", "WITHIN_MONTH", "1_TO_6_MONTHS", "OVER_6_MONTHS", "NOT_APPLICABLE"], "k"),
    60: cycle(["YES_REQUIRED_NOT_APPOINTED", "NO_REQUIREMENT", "YES_REQUIRED_AND_APPOINTED", "NOT_DISCUSSED"], "k"),
    62: cycle(["SINGLE_JURISDICTION_DOMESTIC", "LEAD_SUPERVISORY_AUTHORITY_CASE", "CONCERNED_AUTHORITY_CASE",
               "NON_EU_ENTITY_INVOLVED", "JOINT_INVESTIGATION", "UNCLEAR", None], "k"),
    63: cycle(["YES_VIOLATIONS_FOUND", "YES_COMPLIANT_TRANSFERS", "NOT_DISCUSSED"], "k"),
    65: cycle(["ROUTINE_APPLICATION", "YES_CLARIFIES_EXISTING_LAW", "YES_SIGNIFICANT_PRECEDENT", "UNCLEAR"], "k"),
    67: f"CASE k % 4 WHEN 0 THEN 'EDPB Guidelines ' || {text_of('k % 9 + 1')} || '/2019 and 07/2020'"
        f" WHEN 1 THEN 'Opinion 3/2018, Guidelines ' || {text_of('k % 12 + 1')} || '/2021' WHEN 2 THEN NULL"
        " ELSE '\u200bNo reference' END",
    68: f"'Case ' || {text_of('k')} || ': the authority reviewed ' || prio || ' processing'",
})
for _q in MULTI_SELECT_OPTIONS:
    if _q != "Q35":
        ANSWERS[int(_q[1:])] = multi(_q)
_duration = cycle(["DAYS", "WEEKS", "MONTHS", "ONGOING", "NOT_SPECIFIED"], "k")
ANSWERS[40] = _duration

# A third of the decisions answer every question.
for _i in ANSWERS:
    ANSWERS[_i] = f"COALESCE({ANSWERS[_i]}, CASE WHEN k % 3 = 0 THEN 'UNCLEAR' END)"

# Layout quirks of the text, and what a parser has to make of them.
BLANK_44 = "k % 29 = 7"      # an empty answer swallows the next line
REPEAT_40 = "k % 31 = 3"     # a later answer to the same question wins
EXTRA_69 = "k % 37 = 1"      # more questions than expected
PADDED_01 = "k % 47 = 6"     # 'Answer 01' is a key of its own
QUOTED = "k % 43 = 5"        # quotes around the whole block
WINDOWS = "k % 59 = 0"       # \r\n line ends
INDENTED_6 = "k % 41 = 2"    # an indented line is no answer

EXPECTED: dict[int, str] = dict(ANSWERS)
EXPECTED[44] = f"CASE WHEN {BLANK_44} THEN 'Answer 45: ' || {ANSWERS[45]} ELSE {ANSWERS[44]} END"
EXPECTED[45] = f"CASE WHEN {BLANK_44} THEN NULL ELSE {ANSWERS[45]} END"
EXPECTED[40] = f"CASE WHEN {REPEAT_40} THEN 'YEARS' ELSE {ANSWERS[40]} END"
EXPECTED[6] = f"CASE WHEN {INDENTED_6} THEN NULL ELSE {ANSWERS[6]} END"
EXPECTED[68] = f"{ANSWERS[68]} || CASE WHEN {QUOTED} THEN '\"' ELSE '' END"
EXPECTED[67] = f"trim({ANSWERS[67]}, '\u200b')"  # DuckDB only


def _text_lines() -> list[str]:
    lines = []
    for i in range(1, 69):
        line = f"'Answer {i}: ' || {ANSWERS[i]}"
        if i == 1:
            line = f"CASE WHEN {QUOTED} THEN '\"' ELSE '' END || {line}"
        if i == 6:
            line = f"CASE WHEN {INDENTED_6} THEN '  ' ELSE '' END || {line}"
        if i == 44:
            line = f"CASE WHEN {BLANK_44} THEN 'Answer 44: ' ELSE {line} END"
        if i == 68:
            lines.append(f"CASE WHEN {REPEAT_40} THEN 'Answer 40: YEARS' END")
            lines.append(f"CASE WHEN {PADDED_01} THEN 'Answer 01: ZZ' END")
            lines.append(f"CASE WHEN {EXTRA_69} THEN 'Answer 69: EXTRA' END")
            line = f"{line} || CASE WHEN {QUOTED} THEN '\"' ELSE '' END"
        lines.append(line)
    return lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task works on.
TASK_ROWS = 50_000


def tasks_for(df: DataFrame) -> int:
    """One task for each core, or as many times that as keep a task below ``TASK_ROWS`` rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, -(-df.count() // (TASK_ROWS * cores)))


def spread(df: DataFrame) -> DataFrame:
    """A test file is one row group, so one task; give every core a share, and large tables more tasks."""
    tasks = tasks_for(df)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; large tables are dealt after the join, whose partitions are merged by the bytes of these short rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    tasks = tasks_for(orders)
    large = tasks > spark.sparkContext.defaultParallelism
    joined = spark.sql(
        BASE_SQL.replace("FROM orders o", "FROM {orders} o").replace("JOIN customer c", "JOIN {customer} c"),
        orders=orders if large else spread(orders),
        customer=table(spark, sf_dir, "customer"),
    )
    return joined.repartition(tasks) if large else joined


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master table ``(ID, response)``: one answer block per order.

    The lambda keeps the lines out of whole-stage code, which puts them all in one method, too long to be compiled.
    """
    lines = [F.expr(line) for line in _text_lines()]
    text = F.concat_ws("\n", *lines)
    crlf = F.exists(F.array(F.expr(WINDOWS)), lambda windows: windows)
    return base(spark, sf_dir).select(
        F.concat(F.lit("D"), F.col("k").cast("string")).alias("ID"),
        text.alias("response"),
        crlf.alias("crlf"),
    ).select(
        "ID",
        F.when(F.col("crlf"), F.replace("response", F.lit("\n"), F.lit("\r\n")))
        .otherwise(F.col("response")).alias("response"),
    )


def answers_cte(*questions: int, extra: str = "") -> str:
    """``WITH base AS (..), ans AS (id, k, n, day, q<i>, ..)`` for the oracle."""
    columns = ", ".join(f"{EXPECTED[i]} AS q{i}" for i in questions)
    columns = (", " + columns) if columns else ""
    more = f", {extra}" if extra else ""
    return f"WITH base AS ({BASE_SQL}), ans AS (SELECT 'D' || CAST(k AS STRING) AS id, k, n, day, cents, prio{columns} FROM base){more}"
