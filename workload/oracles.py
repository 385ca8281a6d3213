"""DuckDB SQL for the registered queries.

The SQL starts from the answer *values* (``answers_cte``) or from the base
tables, never from Spark output or parsed text.
"""

from __future__ import annotations

from caseloom import vocab
from caseloom.operators import derived as dv
from caseloom.operators.wide import WIDE_COLUMNS
from workload.answers import (
    _CODE, ANSWERS, BLANK_44, EXPECTED, EXTRA_69, PADDED_01, REPEAT_40, answers_cte,
)
from workload.queries import BUREAU, DECIDED_TEXT, FINE_TEXT, LAND, SPELT, TOLERATED, event_answer

ORACLES: dict[str, str] = {}

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ZW = r"[\x{200b}\x{200c}\x{200d}\x{feff}]"


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def raw(x: str) -> str:
    return strip(f"coalesce({x}, '')")


def echo(x: str) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in vocab.ECHO_PREFIXES) + ")"


def pieces(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda v: {strip('v')}), lambda v: v <> '')"


def toks(x: str) -> str:
    return f"list_filter({pieces(x)}, lambda v: NOT {echo('v')})"


def distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def known(q: str, t: str, negate: bool = False) -> str:
    test = f"list_contains([{names(vocab.MULTI_SELECT_OPTIONS[q])}], v)"
    return f"list_filter({t}, lambda v: {'NOT ' if negate else ''}{test})"


def without(t: str, values) -> str:
    return f"list_filter({t}, lambda v: v NOT IN ({names(values)}))"


def joined(t: str, sep: str = ",") -> str:
    return f"coalesce(array_to_string({t}, '{sep}'), '')"


def only(t: str, v: str) -> str:
    return f"(list_contains({t}, '{v}') AND len(list_filter({t}, lambda v: v <> '{v}')) = 0)"


def ms_status(q: str, t: str) -> str:
    """``q`` is a SQL expression."""
    return (
        f"CASE WHEN len({t}) = 0 THEN 'NOT_MENTIONED'"
        f" WHEN {q} IN ('Q31', 'Q57') AND list_contains({t}, 'NONE_VIOLATED') THEN 'NONE_VIOLATED'"
        f" WHEN {q} IN ('Q31', 'Q57') AND list_contains({t}, 'NOT_DETERMINED') THEN 'NOT_DETERMINED'"
        f" WHEN {only(t, 'NOT_APPLICABLE')} THEN 'NOT_APPLICABLE'"
        f" WHEN {only(t, 'NONE_MENTIONED')} THEN 'NONE_MENTIONED'"
        f" WHEN {q} = 'Q30' AND {only(t, 'NONE_DISCUSSED')} THEN 'NONE_DISCUSSED' ELSE 'DISCUSSED' END"
    )


def conflict(t: str) -> str:
    m = names(vocab.EXCLUSIVE_MARKERS)
    return (f"CASE WHEN len(list_filter({t}, lambda v: v IN ({m}))) > 0"
            f" AND len(list_filter({t}, lambda v: v NOT IN ({m}))) > 0 THEN 1 ELSE 0 END")


def date_steps(source: str) -> str:
    """CTEs ``dates``: everything of ``source`` plus draw, dval, dstatus."""
    shape = "^[0-9]{4}-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12][0-9]|0[1-9]|[1-9])$"
    return (
        f"d0 AS (SELECT *, {raw('q3')} AS draw FROM {source}),"
        f" d1 AS (SELECT *, CASE WHEN regexp_matches(draw, '{shape}') THEN CAST(try_strptime(draw, '%Y-%m-%d') AS DATE) END AS dval FROM d0),"
        f" dates AS (SELECT *, CASE WHEN draw = '' THEN 'NOT_MENTIONED' WHEN draw IN ({names(vocab.DATE_STATUS_TOKENS)}) THEN draw"
        " WHEN dval IS NOT NULL THEN 'DISCUSSED' ELSE 'PARSE_ERROR' END AS dstatus FROM d1)"
    )


def number_steps(source: str, out: str, **columns: str) -> str:
    """CTE ``out``: for each ``prefix=answer column`` adds raw, san, val, status, error."""
    p = list(columns)
    one_dot = ("CASE WHEN len({0}) - len(replace({0}, '.', '')) > 1 THEN replace(left({0}, len({0}) - strpos(reverse({0}), '.')), '.', '')"
               " || '.' || right({0}, strpos(reverse({0}), '.') - 1) ELSE {0} END")
    s0 = ", ".join(f"{raw(c)} AS {x}_raw" for x, c in columns.items())
    s1 = ", ".join(f"regexp_replace(regexp_replace({x}_raw, '[^0-9eE+\\-., ]+', '', 'g'), '[ ,]', '', 'g') AS {x}_s" for x in p)
    s2 = ", ".join(f"{one_dot.format(x + '_s')} AS {x}_san" for x in p)
    s3 = ", ".join(f"try_cast({x}_san AS DOUBLE) AS {x}_num" for x in p)
    s4 = ", ".join(
        f"CASE WHEN {x}_raw = '' THEN 'NOT_MENTIONED' WHEN {x}_raw IN ({names(vocab.NUMBER_STATUS_TOKENS)}) THEN {x}_raw"
        f" WHEN {x}_num IS NULL THEN 'PARSE_ERROR' WHEN {x}_num < 0 THEN 'NEGATIVE_VALUE' ELSE 'DISCUSSED' END AS {x}_status" for x in p)
    s5 = ", ".join(
        f"CASE WHEN {x}_status = 'DISCUSSED' THEN {x}_num END AS {x}_val,"
        f" CASE WHEN {x}_status = 'PARSE_ERROR' AND {x}_san = '' THEN 'sanitized_numeric_string_empty'"
        f" WHEN {x}_status = 'PARSE_ERROR' THEN 'invalid_number' WHEN {x}_status = 'NEGATIVE_VALUE' THEN 'value_lt_zero' END AS {x}_error" for x in p)
    chain, last = [], source
    for i, select in enumerate((s0, s1, s2, s3, s4, s5)):
        name = out if i == 5 else f"{out}_{i}"
        chain.append(f"{name} AS (SELECT *, {select} FROM {last})")
        last = name
    return ", ".join(chain)


def country_cols(q1: str) -> tuple[str, str]:
    """(steps over ``ans``, select list)"""
    p = vocab.COUNTRY_PREFIX
    steps = (
        f"g0 AS (SELECT *, {raw(q1)} AS graw FROM ans),"
        f" g1 AS (SELECT *, upper(CASE WHEN starts_with(graw, '{p}') THEN {strip("string_split(graw, ':')[-1]")} ELSE graw END) AS gup FROM g0),"
        " geo AS (SELECT *, CASE WHEN gup = 'UK' THEN 'GB' ELSE gup END AS country_code FROM g1)"
    )
    cols = (
        "country_code, CASE WHEN graw = '' THEN 'NOT_MENTIONED' ELSE 'DISCUSSED' END AS country_status,"
        f" CASE WHEN country_code = '' THEN 'UNKNOWN' WHEN country_code IN ({names(vocab.EU_CODES)}) THEN 'EU'"
        f" WHEN country_code IN ({names(vocab.EEA_ONLY_CODES)}) THEN 'EEA_NON_EU' WHEN country_code = 'EU' THEN 'EU_INSTITUTION'"
        " ELSE 'NON_EEA' END AS country_group,"
        " CAST(gup = 'UK' AS INTEGER) AS country_mapped_from_uk,"
        f" CAST(country_code IN ({names(vocab.COUNTRY_WHITELIST)}) AS INTEGER) AS country_whitelist_ok"
    )
    return steps, cols


# --- parsing -----------------------------------------------------------------
_all = list(range(1, 69))
ORACLES["p2_parse_answers"] = answers_cte() + (
    " SELECT 'D' || CAST(k AS STRING) AS ID, " + ", ".join(f"{EXPECTED[i]} AS Q{i}" for i in _all)
    + f", CASE WHEN {EXTRA_69} THEN 'EXTRA' END AS Q69, CASE WHEN {PADDED_01} THEN 'ZZ' END AS Q01 FROM base"
)
_present = [f"CAST(q{i} IS NOT NULL AS INTEGER)" for i in _all]
_lines = " + ".join(
    f"CAST(({BLANK_44}) OR ({ANSWERS[i]}) IS NOT NULL AS INTEGER)" if i == 44 else f"CAST(({ANSWERS[i]}) IS NOT NULL AS INTEGER)"
    for i in _all
)
_META = answers_cte(*_all) + (
    ", counted AS (SELECT id, k, " + " + ".join(_present)
    + f" + CAST({EXTRA_69} AS INTEGER) + CAST({PADDED_01} AS INTEGER) AS question_count,"
    + " list_filter([" + ", ".join(f"CASE WHEN q{i} IS NULL THEN 'Q{i}' END" for i in _all) + "], lambda v: v IS NOT NULL) AS lost FROM ans),"
    + f" lines AS (SELECT k, {_lines} + CAST({EXTRA_69} AS INTEGER) + CAST({PADDED_01} AS INTEGER) + CAST({REPEAT_40} AS INTEGER) AS line_count FROM base),"
    + " meta AS (SELECT id AS ID, line_count, CAST(question_count = 68 AS INTEGER) AS complete, question_count,"
    + " CASE WHEN question_count = 68 THEN '' ELSE array_to_string(lost, ',') END AS missing,"
    + " CASE WHEN question_count = 68 THEN '' ELSE 'incomplete_record: missing=' || coalesce(array_to_string(lost[1:10], ','), '')"
    + " || CASE WHEN len(lost) > 10 THEN '...' ELSE '' END END AS warnings, '1.1.0' AS parser_version"
    + " FROM counted JOIN lines USING (k))"
)
ORACLES["p3_parse_metadata"] = _META + " SELECT * FROM meta"

_BLOBS = (
    "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),"
    " x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),"
    " b AS (SELECT doc_id, CAST(floor(i / 5) AS BIGINT) AS blk, i, CASE WHEN i % 5 <> 0 THEN 'Answer ' || CAST(i % 5 + 1 AS STRING) || ': '"
    " ELSE CASE (doc_id + CAST(floor(i / 5) AS BIGINT)) % 4 WHEN 0 THEN 'Answer 1: ' WHEN 1 THEN '\"Answer 1: ' WHEN 2 THEN 'Answer  1: '"
    " ELSE 'Answer 1:' END END || line AS line, line AS bare FROM x),"
    f" s AS (SELECT doc_id, blk, {strip('string_agg(line, chr(10) ORDER BY i)')} AS block FROM b GROUP BY doc_id, blk),"
    " kept AS (SELECT doc_id, blk, row_number() OVER (PARTITION BY doc_id ORDER BY blk) - 1 AS record_index, block FROM s"
    " WHERE (doc_id + blk) % 4 <> 2)"
)
ORACLES["p1_segment_blocks"] = _BLOBS + (
    " SELECT doc_id, CAST(record_index AS INTEGER) AS record_index, CAST(length(block) AS INTEGER) AS n_chars, md5(block) AS digest FROM kept"
)
_FILES = _BLOBS + (
    ", filed AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id, blk) - 1 AS file_index FROM kept)"
)
ORACLES["s2_block_files"] = _FILES + (
    " SELECT CAST(doc_id % 8 AS INTEGER) AS part, CAST(file_index AS INTEGER) AS record_index, CAST(length(block) AS INTEGER) AS n_chars,"
    " md5(block) AS digest FROM filed"
)
# A blank answer takes the line after it as its value, and that line is no answer any more;
# a blank last line is none either.
_taken = ["false"]
for _i in range(1, 5):
    _taken.append(f"(blank[{_i}] AND NOT {_taken[-1]})")
_value = (
    f"CASE WHEN blank[i] THEN {strip('ls[i + 1]')} ELSE trim({strip('bares[i]')}, chr(8203)) END"
)
ORACLES["v5_k6_parse_blocks"] = _FILES + (
    f", per AS (SELECT doc_id, blk, list(line ORDER BY i) AS ls, list(bare ORDER BY i) AS bares, list({strip('bare')} = '' ORDER BY i) AS blank FROM b GROUP BY doc_id, blk),"
    f" marked AS (SELECT f.file_index, f.block, ls, bares, blank, [{', '.join(_taken)}] AS taken FROM filed f JOIN per p ON f.doc_id = p.doc_id AND f.blk = p.blk),"
    " found AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: NOT coalesce(taken[i], false) AND (NOT blank[i] OR i < len(ls))) AS hits FROM marked),"
    f" said AS (SELECT *, list_transform(hits, lambda i: 'Q' || CAST(i AS VARCHAR) || '=' || {_value}) AS answers FROM found)"
    " SELECT CAST(file_index AS INTEGER) AS record_index, true AS timed, CAST(len(hits) AS INTEGER) AS question_count,"
    r" CAST(len(ls) + len(regexp_extract_all(block, '\r\n?|[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) AS INTEGER) AS line_count,"
    " 0 AS complete, CAST(68 - len(hits) AS INTEGER) AS n_missing, 1 AS n_warnings, '1.1.0' AS parser_version,"
    " md5(array_to_string(answers, chr(10))) AS digest FROM said"
)
ORACLES["s1_master_csv"] = _META + (
    ", vals AS (SELECT id, " + ", ".join(f"q{i} AS Q{i}" for i in _all) + " FROM ans)"
    " SELECT meta.ID, meta.question_count, vals.* EXCLUDE (id) FROM meta JOIN vals ON meta.ID = vals.id"
)

# --- typed scalars -----------------------------------------------------------
ORACLES["f1_f2_dates"] = answers_cte(3, extra=date_steps("ans")) + (
    " SELECT id AS ID, draw AS raw, CAST(dval AS STRING) AS value, dstatus AS status,"
    " CASE WHEN dstatus = 'PARSE_ERROR' THEN 'invalid_date' END AS error,"
    " CAST(dval AS STRING) || 'T00:00:00+00:00' AS iso, CAST(year(dval) AS INTEGER) AS year,"
    " 'Q' || CAST(quarter(dval) AS STRING) AS quarter FROM dates"
)
_gsteps, _gcols = country_cols("q1")
ORACLES["f3_f4_j3_country"] = answers_cte(1, extra=_gsteps) + f" SELECT id AS ID, {_gcols} FROM geo"
ORACLES["f5_f6_numbers"] = answers_cte(
    37, 38, extra="u AS (SELECT id, 'Q37' AS question, q37 AS a FROM ans UNION ALL SELECT id, 'Q38', q38 FROM ans), " + number_steps("u", "nums", n="a")
) + (
    " SELECT id AS ID, question, n_raw AS raw, n_san AS sanitized, round(n_val, 4) AS value, n_status AS status,"
    " CAST(n_status NOT IN ('PARSE_ERROR', 'NEGATIVE_VALUE') AS INTEGER) AS valid, n_error AS error FROM nums"
)


def money_cols(x: str, prefix: str, limit: float) -> str:
    return (
        f"round({x}_val, 4) AS {prefix}_eur, CAST({x}_status NOT IN ('PARSE_ERROR', 'NEGATIVE_VALUE') AS INTEGER) AS {prefix}_numeric_valid,"
        f" CAST(coalesce({x}_val, 0) > 0 AS INTEGER) AS {prefix}_positive, round(ln(1 + {x}_val), 6) AS {prefix}_log1p,"
        f" CAST(coalesce({x}_val, 0) > {limit:.0f} AS INTEGER) AS {prefix}_outlier_flag, {x}_raw AS {prefix}_raw,"
        f" {x}_status AS {prefix}_status, {x}_error AS {prefix}_error"
    )


_MONEY = (
    money_cols("f", "fine", vocab.FINE_OUTLIER) + ", " + money_cols("t", "turnover", vocab.TURNOVER_OUTLIER)
    + ", round(CASE WHEN t_val > 0 THEN f_val / t_val END, 6) AS fine_to_turnover_ratio"
)
ORACLES["f7_f8_money"] = answers_cte(37, 38, extra=number_steps("ans", "nums", f="q37", t="q38")) + f" SELECT id AS ID, {_MONEY} FROM nums"


def norm(x: str) -> str:
    inner = strip(f"regexp_replace(nfc_normalize(coalesce({x}, '')), '{ZW}', '', 'g')")
    return f"regexp_replace({inner}, '{WS}+', ' ', 'g')"


def text_facts(t: str, tokens: str, lang: str) -> str:
    other = f"length(regexp_replace({t}, '[\\x00-\\x7f]+', '', 'g'))"
    return (
        f"CAST(CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, ' ')) END AS INTEGER) AS {tokens},"
        f" CASE WHEN {t} <> '' AND (length({t}) - {other}) / length({t}) > 0.95 THEN 'ENGLISH_LIKELY' ELSE 'UNKNOWN' END AS {lang}"
    )


ORACLES["f9_f10_f15_text"] = (
    "WITH t AS (SELECT doc_id, " + norm("'  cafe\u0301 \u00a0' || text || ' \u2003 x\u200by\ufeff \u00a0'") + " AS t FROM documents)"
    f" SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n_chars, {text_facts('t', 'n_tokens', 'language')} FROM t"
)
_NAME = f"CASE WHEN {echo('nm')} THEN '' ELSE nm END"
_ECHO = (
    f"CAST({echo('nm')} OR {echo('sec')} AS INTEGER) AS schema_echo_flag,"
    f" CASE WHEN {echo('nm')} AND {echo('sec')} THEN 'Q12;Q2' WHEN {echo('nm')} THEN 'Q2' WHEN {echo('sec')} THEN 'Q12' ELSE '' END AS schema_echo_fields"
)
_INGEST = (
    "'1.1.0' AS ingest_parser_version, line_count AS ingest_line_count, question_count AS ingest_question_count,"
    " replace(missing, ',', ';') AS ingest_missing_questions, CAST(warnings <> '' AS INTEGER) AS ingest_warning_count, warnings AS ingest_warnings"
)
ORACLES["f11_f14_flags"] = _META + (
    f", z AS (SELECT id, {raw('q2')} AS nm, {raw('q12')} AS sec, q16 FROM ans)"
    f" SELECT meta.ID, {_INGEST}, nm AS dpa_name_raw, {_NAME} AS dpa_name_canonical, {_ECHO},"
    " CAST(coalesce(q16, '') = 'YES' AS INTEGER) AS breach_case FROM meta JOIN z ON meta.ID = z.id"
)

# --- multi-select ------------------------------------------------------------
_WQ = [int(q[1:]) for q, _ in vocab.WIDE_FIELDS]


def long_answers(questions) -> str:
    return "u AS (" + " UNION ALL ".join(f"SELECT id, 'Q{i}' AS question, q{i} AS a FROM ans" for i in questions) + ")"


ORACLES["a1_a5_multiselect"] = answers_cte(*_WQ, extra=long_answers(_WQ) + f", v AS (SELECT id, question, len({pieces('a')}) AS n_raw, {toks('a')} AS t FROM u)") + (
    f" SELECT id AS ID, question, CAST(n_raw AS INTEGER) AS n_raw, {joined('t')} AS tokens, {joined(distinct('t'))} AS distinct_tokens,"
    f" {ms_status('question', 't')} AS status, {conflict('t')} AS conflict FROM v"
)


def measure_cols(t30: str, t31: str, t53: str, fine: str) -> str:
    violated = f"list_filter({known('Q31', t31)}, lambda v: NOT starts_with(v, 'NONE_') AND v <> 'NOT_DETERMINED')"
    return (
        f"CAST(len({known('Q30', t30)}) AS INTEGER) AS n_principles_discussed, CAST(len({violated}) AS INTEGER) AS n_principles_violated,"
        f" CAST(len({without(known('Q53', t53), ['NONE'])}) AS INTEGER) AS n_corrective_measures,"
        f" CAST(list_has_any({known('Q53', t53)}, [{names(vocab.SEVERITY_MEASURES)}]) AS INTEGER) AS severity_measures_present,"
        f" CAST(coalesce({fine}, 0) = 0 AND len({without(known('Q53', t53), ['NONE', 'ADMINISTRATIVE_FINE'])}) > 0 AS INTEGER) AS remedy_only_case"
    )


_T = lambda *qs: ", ".join(f"{toks(f'q{i}')} AS t{i}" for i in qs)
ORACLES["a6_a7_measures"] = answers_cte(
    30, 31, 37, 53, extra=number_steps("ans", "nums", f="q37") + f", m AS (SELECT id, f_val, {_T(30, 31, 53)} FROM nums)"
) + f" SELECT id AS ID, {measure_cols('t30', 't31', 't53', 'f_val')} FROM m"

_LISTING = (
    "SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 40 = 0 THEN chr(CAST(65 + floor(p_partkey / 40) % 26 AS INT))"
    " WHEN p_partkey % 40 = 1 THEN lpad(CAST(CAST(floor(p_partkey / 40) AS BIGINT) % 100 AS STRING), 2, '0')"
    " ELSE lpad(CAST(p_partkey * 7 % 10000 AS STRING), 4, '0') END AS code, p_name || ' ' || p_type AS description FROM part"
)
_SECTORS = (
    f"listing AS ({_LISTING}), filled AS (SELECT *, last_value(CASE WHEN regexp_matches(code, '^[A-Z]$') THEN code END IGNORE NULLS)"
    " OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM listing),"
    " sectors AS (SELECT code, description, section FROM filled QUALIFY row_number() OVER (PARTITION BY code ORDER BY ordinal DESC) = 1)"
)
ORACLES["w1_s5_sector_sections"] = f"WITH {_SECTORS} SELECT * FROM sectors"


def sector_cols(source: str, code: str) -> str:
    return (
        f"sec AS (SELECT s.id AS sid, coalesce(x.code, d.code, {code}) AS isic_code, coalesce(x.description, d.description, '') AS isic_desc,"
        f" coalesce(x.section, d.section, '') AS isic_section FROM {source} s LEFT JOIN sectors x ON {code} = x.code"
        f" LEFT JOIN sectors d ON x.code IS NULL AND length({code}) >= 2 AND left({code}, 2) = d.code)"
    )


ORACLES["j2_sector_lookup"] = answers_cte(12, extra=f"{_SECTORS}, z AS (SELECT id, coalesce(q12, '') AS c12 FROM ans), {sector_cols('z', 's.c12')}") + (
    " SELECT sid AS ID, isic_code, isic_desc, isic_section FROM sec"
)
_OPTIONS = vocab.MULTI_SELECT_OPTIONS | vocab.OTHER_MULTI_SELECT_OPTIONS | vocab.ENUM_OPTIONS
_OQ = sorted(int(q[1:]) for q in _OPTIONS)
_book = ", ".join(f"('{q}', '{t}')" for q, v in _OPTIONS.items() for t in v)
_EXPL = f"e AS (SELECT id, question, unnest({toks('a')}) AS token FROM u), book(question, token) AS (VALUES {_book})"
ORACLES["j1_validate_tokens"] = answers_cte(*_OQ, extra=long_answers(_OQ) + ", " + _EXPL) + (
    " SELECT question, token, CASE WHEN EXISTS (SELECT 1 FROM book b WHERE b.question = e.question AND b.token = e.token)"
    " THEN 'KNOWN' ELSE 'UNKNOWN' END AS token_status, count(*) AS n FROM e GROUP BY 1, 2, 3"
)
ORACLES["j1_known_and_unknown"] = answers_cte(*_WQ, extra=long_answers(_WQ) + ", " + _EXPL) + (
    ", f AS (SELECT question, EXISTS (SELECT 1 FROM book b WHERE b.question = e.question AND b.token = e.token) AS ok FROM e)"
    " SELECT question, count(*) AS n, CASE WHEN ok THEN 'known' ELSE 'unknown' END AS side FROM f GROUP BY question, ok"
)

# --- tables and reports ------------------------------------------------------
_TEXTS = [int(q[1:]) for q in vocab.TEXT_QUESTIONS]
_WIDE_STEPS = (
    _META + ", " + _SECTORS + ", " + _gsteps.replace("FROM ans", "FROM ans", 1) + ", " + date_steps("geo") + ", "
    + number_steps("dates", "nums", f="q37", t="q38")
    + f", w AS (SELECT *, {raw('q2')} AS nm, {raw('q12')} AS sec, {_T(*_WQ)}, " + ", ".join(f"{norm(f'q{i}')} AS x{i}" for i in _TEXTS) + " FROM nums)"
    + f", w2 AS (SELECT *, CASE WHEN {echo('sec')} THEN '' ELSE sec END AS sc FROM w), {sector_cols('w2', 's.sc')}"
)


def field_cols(q: str, prefix: str) -> str:
    t = f"t{q[1:]}"
    return (f"{joined(known(q, t))} AS {prefix}_known, {joined(known(q, t, True))} AS {prefix}_unknown,"
            f" {ms_status(repr(q), t)} AS {prefix}_status, {conflict(t)} AS {prefix}_exclusivity_conflict")


ORACLES["v1_a8_wide"] = _WIDE_STEPS + (
    f" SELECT w2.id AS decision_id, {_INGEST}, {_gcols}, nm AS dpa_name_raw, {_NAME} AS dpa_name_canonical,"
    " draw AS decision_date_raw, CAST(dval AS STRING) AS decision_date, dstatus AS decision_date_status,"
    " CASE WHEN dstatus = 'PARSE_ERROR' THEN 'invalid_date' END AS decision_date_error,"
    " CAST(year(dval) AS INTEGER) AS decision_year, 'Q' || CAST(quarter(dval) AS STRING) AS decision_quarter,"
    f" {_MONEY}, isic_code, isic_desc, isic_section, {measure_cols('t30', 't31', 't53', 'f_val')},"
    " CAST(coalesce(q16, '') = 'YES' AS INTEGER) AS breach_case, "
    + ", ".join(f"x{i} AS q{i}_text, {text_facts(f'x{i}', f'q{i}_tokens', f'q{i}_lang')}" for i in _TEXTS)
    + f", {_ECHO}, " + ", ".join(field_cols(q, p) for q, p in vocab.WIDE_FIELDS)
    + " FROM w2 JOIN meta ON meta.ID = w2.id JOIN sec ON sec.sid = w2.id"
)
_LQ = [int(q[1:]) for _, q in vocab.LONG_ROLES]
_roles = " UNION ALL ".join(f"SELECT id, '{r}' AS role, '{q}' AS question, q{q[1:]} AS a FROM ans" for r, q in vocab.LONG_ROLES if q != "Q35")
ORACLES["v2_a9_a11_long"] = answers_cte(*_LQ, extra=(
    f"u AS ({_roles}), v AS (SELECT id, role, question, len({pieces('a')}) AS n_raw, {distinct(toks('a'))} AS t FROM u),"
    f" e AS (SELECT id, role, question, {ms_status('question', 't')} AS status, unnest(t) AS option FROM v),"
    f" book(question, token) AS (VALUES {_book}), one AS (SELECT id, {raw('q35')} AS o FROM ans)"
)) + (
    " SELECT e.id AS decision_id, role, option, status, CASE WHEN b.token IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS token_status"
    " FROM e LEFT JOIN book b ON b.question = e.question AND b.token = e.option"
    " UNION ALL SELECT id, role, 'DISCUSSED', 'DISCUSSED', 'STATUS_ONLY' FROM v WHERE len(t) = 0 AND n_raw > 0"
    f" UNION ALL SELECT id, 'li_test_outcome', o, 'DISCUSSED', CASE WHEN o IN ({names(vocab.MULTI_SELECT_OPTIONS['Q35'])}) THEN 'KNOWN' ELSE 'UNKNOWN' END"
    f" FROM one WHERE o <> '' AND NOT {echo('o')}"
)


def rules(a=lambda q: f"q{q}") -> list[tuple[str, str]]:
    v = lambda q: f"coalesce({a(q)}, '')"
    amount = "coalesce(f_val, 0)"
    cross = (f"({v(49)} IN ('YES_LEAD_AUTHORITY_CASE', 'YES_MULTIPLE_DPAS_INVOLVED') OR {v(62)} IN"
             " ('LEAD_SUPERVISORY_AUTHORITY_CASE', 'CONCERNED_AUTHORITY_CASE', 'JOINT_INVESTIGATION'))")
    return [
        ("q17_yes_required_but_q18_not_applicable", f"{v(17)} = 'YES_REQUIRED' AND {v(18)} = 'NOT_APPLICABLE'"),
        ("q18_submitted_but_q16_no_breach", f"starts_with({v(18)}, 'YES_') AND {v(16)} = 'NO'"),
        ("q27_yes_required_but_q16_not_yes", f"{v(27)} = 'YES_REQUIRED' AND {v(16)} <> 'YES'"),
        ("q26_yes_notified_but_q16_no_breach", f"{v(26)} = 'YES_NOTIFIED' AND {v(16)} = 'NO'"),
        ("q60_required_not_appointed_but_q61_missing_no_dpo",
         f"{v(60)} = 'YES_REQUIRED_NOT_APPOINTED' AND strpos({v(61)}, 'NO_DPO_APPOINTED') = 0"),
        ("admin_fine_present_but_fine_zero_or_invalid", f"strpos({v(53)}, 'ADMINISTRATIVE_FINE') > 0 AND {amount} <= 0"),
        ("fine_amount_parse_error", "f_status = 'PARSE_ERROR'"),
        ("appeal_outcome_present_but_q4_no", f"{v(4)} = 'NO' AND {v(5)} <> 'NOT_APPLICABLE'"),
        ("cap_hit_with_zero_fine", f"{amount} = 0 AND starts_with({v(39)}, 'HIT_')"),
        ("turnover_parse_error", "t_status = 'PARSE_ERROR'"),
        ("turnover_cap_claim_unverifiable_turnover_missing", f"{v(39)} = 'HIT_4PCT_TURNOVER_CAP' AND t_raw = ''"),
        ("cross_border_claim_requires_geo_verification",
         f"{cross} AND {v(62)} <> 'NON_EU_ENTITY_INVOLVED' AND NOT ends_with({v(1)}, ': EU')"),
    ]


_CHECKED = (1, 4, 5, 16, 17, 18, 26, 27, 37, 38, 39, 49, 53, 60, 61, 62)
_case = lambda pairs: ", ".join(f"CASE WHEN {test} THEN '{n}' END" for n, test in pairs)
ORACLES["v3_b4_consistency"] = answers_cte(*_CHECKED, extra=number_steps("ans", "nums", f="q37", t="q38")) + (
    f", fl AS (SELECT id AS decision_id, concat_ws(';', {_case(rules())}) AS flags FROM nums) SELECT * FROM fl WHERE flags <> ''"
)
ORACLES["b5_validation"] = answers_cte(37, 38, 53, extra=number_steps("ans", "nums", f="q37", t="q38")) + (
    " SELECT id AS decision_id, concat_ws(';', " + _case([
        ("admin_fine_but_zero_amount", "strpos(coalesce(q53, ''), 'ADMINISTRATIVE_FINE') > 0 AND NOT coalesce(f_val, 0) > 0"),
        ("fine_parse_error", "f_status = 'PARSE_ERROR'"), ("turnover_parse_error", "t_status = 'PARSE_ERROR'"),
    ]) + ") AS flags FROM nums"
)
_fields = ", ".join(f"('Q{q[1:]}', '{p}')" for q, p in vocab.WIDE_FIELDS)
_QA = answers_cte(*_WQ, extra=long_answers(_WQ) + (
    f", names(question, field_prefix) AS (VALUES {_fields}), book(question, token) AS (VALUES {_book}),"
    f" v AS (SELECT id, question, field_prefix, {toks('a')} AS t FROM u JOIN names USING (question)),"
    f" s AS (SELECT id, field_prefix, {ms_status('question', 't')} AS status FROM v),"
    " e0 AS (SELECT id, question, field_prefix, unnest(t) AS token FROM v),"
    " e AS (SELECT e0.*, b.token IS NOT NULL AS ok FROM e0 LEFT JOIN book b ON b.question = e0.question AND b.token = e0.token),"
    " sc AS (SELECT field_prefix, status, count(*) AS n FROM s GROUP BY 1, 2),"
    " tk AS (SELECT field_prefix, token, count(*) AS n FROM e WHERE NOT ok GROUP BY 1, 2),"
    " rk AS (SELECT *, row_number() OVER (PARTITION BY field_prefix ORDER BY n DESC, token) AS rank FROM tk)"
))
ORACLES["g2_status_counts"] = _QA + " SELECT * FROM sc"
ORACLES["g3_top_unknown"] = _QA + " SELECT field_prefix, CAST(rank AS INTEGER) AS rank, token, n FROM rk WHERE rank <= 3"
ORACLES["v4_g1_g4_qa_summary"] = _QA + (
    ", a AS (SELECT field_prefix, sum(n) AS total_rows, string_agg(status || '=' || CAST(n AS STRING), ';' ORDER BY n DESC, status) AS statuses FROM sc GROUP BY 1),"
    " kn AS (SELECT field_prefix, count(DISTINCT CASE WHEN ok THEN id END) AS rows_with_known, count(DISTINCT CASE WHEN NOT ok THEN id END) AS rows_with_unknown,"
    " count(CASE WHEN NOT ok THEN 1 END) AS total_unknown_tokens FROM e GROUP BY 1),"
    " tt AS (SELECT field_prefix, string_agg(token || '=' || CAST(n AS STRING), ';' ORDER BY rank) AS top_unknown FROM rk WHERE rank <= 5 GROUP BY 1)"
    " SELECT field_prefix, CAST(total_rows AS BIGINT) AS total_rows, coalesce(rows_with_known, 0) AS rows_with_known, coalesce(rows_with_unknown, 0) AS rows_with_unknown,"
    " coalesce(total_unknown_tokens, 0) AS total_unknown_tokens, statuses, coalesce(top_unknown, '') AS top_unknown"
    " FROM names JOIN a USING (field_prefix) LEFT JOIN kn USING (field_prefix) LEFT JOIN tt USING (field_prefix)"
)
_strip_with = lambda sql: sql.removeprefix("WITH ")
ORACLES["v6_run_all"] = (
    f"WITH c AS ({ORACLES['v3_b4_consistency']}), l AS ({ORACLES['v2_a9_a11_long']})"
    " SELECT 'parsed' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'wide', count(*) FROM orders"
    " UNION ALL SELECT 'validation', count(*) FROM orders UNION ALL SELECT 'long', count(*) FROM l"
    f" UNION ALL SELECT 'consistency', count(*) FROM c UNION ALL SELECT 'qa', {len(vocab.WIDE_FIELDS)}"
)
ORACLES |= {
    "v6_k1_wide": ORACLES["v1_a8_wide"], "v6_k2_validation": ORACLES["b5_validation"], "v6_k3_long": ORACLES["v2_a9_a11_long"],
    "v6_k4_consistency": ORACLES["v3_b4_consistency"], "v6_k5_qa_summary": ORACLES["v4_g1_g4_qa_summary"],
}

# --- streams -----------------------------------------------------------------
ORACLES["r1_incremental_parse"] = (
    "SELECT 'E' || CAST(event_id AS STRING) AS ID, CAST(CAST(value AS DECIMAL(12, 2)) AS DOUBLE) AS fine,"
    " CASE event_type WHEN 'error' THEN 'NONE_DISCUSSED' WHEN 'view' THEN 'NOT_APPLICABLE, SECURITY' ELSE 'SECURITY' END AS q30,"
    " CAST(CASE WHEN event_type = 'click' THEN 3 ELSE 4 END AS INTEGER) AS question_count FROM events"
)
ORACLES["r2_drop_redelivered"] = "SELECT DISTINCT CAST(user_id AS STRING) || ':' || event_type AS decision_id FROM events"
_events = " UNION ALL ".join(f"SELECT ts, '{p}' AS field_prefix, '{q}' AS question, {event_answer(q)} AS a FROM events" for q, p in vocab.WIDE_FIELDS)
ORACLES["r3_running_counts"] = (
    f"WITH e AS ({_events}), t AS (SELECT ts, field_prefix, question, {toks('a')} AS t FROM e)"
    f" SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, field_prefix, {ms_status('question', 't')} AS status, count(*) AS n FROM t GROUP BY 1, 2, 3"
)

# --- specified analyses ------------------------------------------------------
#: The questions of several choices.
_multi = {f"Q{i}" for i in (10, 21, 25, 28, 30, 31, 32, 33, 34, 41, 42, 46, 47, 50, 53, 54, 56, 57, 58, 59, 61, 64)}
_mq = sorted(int(q[1:]) for q in _multi)
ORACLES["x1_option_matrix"] = answers_cte(*_mq, extra=f"m AS (SELECT id, {_T(*_mq)} FROM ans)") + (
    " SELECT id AS decision_id, " + ", ".join(
        f"CAST(list_contains(t{i}, '{o}') AS INTEGER) AS Q{i}_{o}" for i in _mq for o in _OPTIONS[f"Q{i}"]) + " FROM m"
)


def plain_status(a: str) -> str:
    r = raw(a)
    return f"CASE WHEN {r} = '' THEN 'NOT_MENTIONED' WHEN {r} IN ({names(vocab.ABSENCE_TOKENS)}) THEN {r} ELSE 'DISCUSSED' END"


def _status_select(i: int) -> str:
    q = f"Q{i}"
    if q in ("Q3", "Q37", "Q38"):
        s = {"Q3": "dstatus", "Q37": "f_status", "Q38": "t_status"}[q]
    elif q in _multi:
        t = f"t{i}"
        s = (f"CASE WHEN len({t}) > 0 AND len({without(t, vocab.ABSENCE_TOKENS)}) = 0 AND ({ms_status(repr(q), t)}) = 'DISCUSSED'"
             f" THEN {t}[1] ELSE {ms_status(repr(q), t)} END")
    else:
        s = plain_status(f"q{i}")
    return s


_STATES = answers_cte(*_all, extra=(
    date_steps("ans") + ", " + number_steps("dates", "nums", f="q37", t="q38") + f", m AS (SELECT *, {_T(*_mq)} FROM nums)"
))
ORACLES["x2_missingness_profile"] = _STATES + ", u AS (" + " UNION ALL ".join(
    f"SELECT 'Q{i}' AS question, {_status_select(i)} AS status FROM m" for i in _all) + ") SELECT question, status, count(*) AS n FROM u GROUP BY 1, 2"
ORACLES["x2_missingness_table"] = _STATES + " SELECT id AS decision_id, " + ", ".join(f"{_status_select(i)} AS Q{i}_status" for i in _all) + " FROM m"
ORACLES["x3_date_features"] = answers_cte(3, extra=date_steps("ans")) + (
    " SELECT id AS decision_id, CAST(dval AS STRING) AS decision_date, CAST(coalesce(year(dval) >= 1995, false) AS INTEGER) AS date_plausible,"
    " CAST(weekofyear(dval) AS INTEGER) AS iso_week, CAST((year(dval) - 1995) * 12 + month(dval) - 1 AS INTEGER) AS month_index,"
    " CAST(date_diff('day', dval, DATE '2025-01-01') AS INTEGER) AS decision_age_days FROM dates"
)
_subst = lambda t: without(t, vocab.ABSENCE_TOKENS)
_detail = " OR ".join(f"len({without(_subst(toks(f'q{q[1:]}')), ['NEITHER'])}) > 0" for q in dv._BREACH_DETAIL)
_unseen = f"list_filter({known('Q31', 't31')}, lambda v: v IN ({names(vocab.PRINCIPLES)}) AND NOT list_contains(t30, v))"
ORACLES["x4_safeguards"] = answers_cte(
    *sorted(set(_WQ) | {1, 16, 38, 39, 49, 62} | {int(q[1:]) for q in dv._BREACH_DETAIL}),
    extra=_gsteps + f", m0 AS (SELECT *, {_gcols.removeprefix('country_code, ')} FROM geo), m AS (SELECT *, {_T(*_WQ)} FROM m0)",
) + (
    " SELECT id AS decision_id, greatest(" + ", ".join(conflict(f"t{i}") for i in _WQ) + ") AS na_conflict_flag,"
    f" CASE WHEN {conflict('t53')} = 1 THEN 'MIXED_CONTRADICTORY' ELSE {ms_status(repr('Q53'), 't53')} END AS powers_audit_status,"
    f" CASE WHEN coalesce(q39, '') = 'HIT_4PCT_TURNOVER_CAP' AND {raw('q38')} = '' THEN 0 ELSE 1 END AS verification_possible,"
    f" {joined(f'list_sort(list_distinct({_unseen}))')} AS violated_not_discussed,"
    f" CAST({rules()[-1][1].split(' AND ')[0]} AND country_group NOT IN ('EU', 'EEA_NON_EU', 'EU_INSTITUTION')"
    " AND coalesce(q62, '') <> 'NON_EU_ENTITY_INVOLVED' AS INTEGER) AS cross_border_outside_area,"
    f" CAST(coalesce(q16, '') = 'NO' AND ({_detail}) AS INTEGER) AS breach_content_without_breach FROM m"
)
_plain = lambda x: f"regexp_replace(lower({strip(x)}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')"
ORACLES["x5_authority_match"] = answers_cte(1, 2, extra=_gsteps + (
    f", nm AS (SELECT DISTINCT gup AS country, q2 AS name, {_plain('q2')} AS pn FROM geo WHERE graw <> '' AND q2 IS NOT NULL AND NOT {echo('q2')} AND {strip('q2')} <> ''),"
    f" reg AS (SELECT CAST(n AS BIGINT) AS authority_id, {_CODE} AS country, 'Data Protection Office No ' || CAST(n AS STRING) AS authority_name"
    " FROM (SELECT n_nationkey AS n FROM nation)),"
    f" c AS (SELECT nm.country, nm.name, pn, authority_id, authority_name, {_plain('authority_name')} AS rn FROM nm JOIN reg ON reg.country = nm.country),"
    " d AS (SELECT *, levenshtein(pn, rn) AS distance FROM c), best AS (SELECT * FROM d WHERE distance <= 3"
    " QUALIFY row_number() OVER (PARTITION BY country, name ORDER BY distance, authority_id) = 1)"
)) + (
    " SELECT nm.country, nm.name, authority_id, authority_name, CAST(distance AS INTEGER) AS distance,"
    " round(1 - distance / greatest(length(best.pn), length(rn)), 6) AS score FROM nm LEFT JOIN best USING (country, name)"
)
ORACLES["x5_many_authorities"] = (
    f"WITH nm AS (SELECT DISTINCT country, name, {_plain('name')} AS pn FROM (SELECT {LAND} AS country, {SPELT} AS name FROM part)),"
    f" reg AS (SELECT p_partkey AS authority_id, {LAND} AS country, {BUREAU} AS authority_name FROM part),"
    f" c AS (SELECT nm.country, nm.name, pn, authority_id, authority_name, {_plain('authority_name')} AS rn FROM nm JOIN reg ON reg.country = nm.country),"
    " d AS (SELECT *, levenshtein(pn, rn) AS distance FROM c WHERE abs(length(pn) - length(rn)) <= 3), best AS (SELECT * FROM d WHERE distance <= 3"
    " QUALIFY row_number() OVER (PARTITION BY country, name ORDER BY distance, authority_id) = 1)"
    " SELECT nm.country, nm.name, authority_id, authority_name, CAST(distance AS INTEGER) AS distance,"
    " round(1 - distance / greatest(length(best.pn), length(rn)), 6) AS score FROM nm LEFT JOIN best USING (country, name)"
)
ORACLES["x6_country_and_sectors"] = answers_cte(1, 12, extra=_gsteps + (
    f", dim AS (SELECT {_CODE} AS code, r_name AS region, n_name AS languages FROM (SELECT *, n_nationkey AS n FROM nation) JOIN region ON n_regionkey = r_regionkey),"
    " z AS (SELECT *, CASE WHEN graw = '' THEN NULL ELSE gup END AS gc,"
    " list_filter(regexp_split_to_array(coalesce(q12, ''), '[^0-9]+'), lambda v: length(v) BETWEEN 2 AND 4) AS cs FROM geo),"
    f" y AS (SELECT *, {distinct('cs')} AS ds FROM z)"
)) + (
    " SELECT id AS ID, gc AS country_code, region, languages, ds[1] AS primary_sector, coalesce(array_to_string(ds[2:], ','), '') AS secondary_sectors,"
    " CAST(len(ds) > 1 AS INTEGER) AS multi_sector FROM y LEFT JOIN dim ON dim.code = gc"
)


def mapped(x: str, table: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN {b!r}" for a, b in table.items()) + " END"


_mid = f"CAST({mapped('q14', vocab.TURNOVER_MIDPOINTS)} AS DOUBLE)"
ORACLES["x7_x8_scales"] = answers_cte(14, 40, 45, 55, 65) + (
    f" SELECT id AS decision_id, q14 AS turnover_range, {_mid} AS turnover_range_midpoint_eur, CAST({_mid} IS NOT NULL AS INTEGER) AS range_imputed,"
    + ", ".join(f" q{i} AS {n}, CAST({mapped(f'q{i}', vocab.ORDINALS[f'Q{i}'])} AS INTEGER) AS {n}_ordinal"
                for i, n in ((40, "duration"), (45, "cooperation"), (55, "deadline"), (65, "precedent"))) + " FROM ans"
)


def _cnt(i: int) -> str:
    return f"CAST(len(list_distinct({_subst(known(f'Q{i}', toks(f'q{i}')))})) AS INTEGER)"


ORACLES["x9_rollups"] = answers_cte(4, 10, 12, 17, 18, 19, 25, 28, 41, 42, 56, 57, 60) + (
    f" SELECT id AS decision_id, {_cnt(56)} AS n_rights_discussed, {_cnt(57)} AS n_rights_violated, {_cnt(41)} AS n_aggravating, {_cnt(42)} AS n_mitigating,"
    f" CAST(list_contains({toks('q10')}, 'PUBLIC_SECTOR_BODY') AS INTEGER) AS public_sector,"
    f" coalesce({_subst(toks('q10'))}[1], 'UNKNOWN') || '|' || coalesce(left(list_filter(regexp_split_to_array(coalesce(q12, ''), '[^0-9]+'), lambda v: length(v) BETWEEN 2 AND 4)[1], 2), 'UNKNOWN') AS size_sector,"
    " CASE WHEN q4 = 'YES' THEN 'appeal' ELSE 'non_appeal' END AS case_class,"
    " CAST(coalesce(q60, '') = 'YES_REQUIRED_NOT_APPOINTED' AS INTEGER) AS dpo_noncompliant,"
    " CASE WHEN coalesce(q17, '') <> 'YES_REQUIRED' THEN 'NOT_REQUIRED' WHEN q18 = 'YES_SUBMITTED' THEN"
    " CASE WHEN q19 = 'YES_WITHIN_72H' THEN 'SUBMITTED_IN_TIME' ELSE 'SUBMITTED_NOT_IN_TIME' END ELSE 'NOT_SUBMITTED' END AS breach_chain,"
    f" CAST(list_contains({toks('q25')}, 'ARTICLE_9_SPECIAL_CATEGORY') AS INTEGER) AS special_category,"
    f" CAST(len(list_distinct({_subst(toks('q28'))})) AS INTEGER) AS n_mitigating_actions FROM ans"
)
ORACLES["x10_frequency_rollup"] = answers_cte(1, 3, extra=_gsteps + ", " + date_steps("geo")) + (
    ", r AS (SELECT country_code, CAST(year(dval) AS INTEGER) AS decision_year, 'Q' || CAST(quarter(dval) AS STRING) AS decision_quarter FROM dates)"
    " SELECT country_code, decision_year, decision_quarter, CAST(grouping(country_code, decision_year, decision_quarter) AS BIGINT) AS level, count(*) AS n"
    " FROM r GROUP BY ROLLUP (country_code, decision_year, decision_quarter)"
)
_FINES = answers_cte(10, 37, 49, extra=number_steps("ans", "nums", f="q37") + (
    f", fines AS (SELECT f_val AS fine_eur, ln(1 + f_val) AS l, coalesce({_subst(toks('q10'))}[1], 'UNKNOWN') AS size_class,"
    " CAST(coalesce(q49, '') IN ('YES_LEAD_AUTHORITY_CASE', 'YES_MULTIPLE_DPAS_INVOLVED') AS INTEGER) AS cross_border FROM nums)"
))
ORACLES["x11_fine_histogram"] = _FINES + (
    " SELECT size_class, cross_border, CAST(CASE WHEN l < 0 THEN 0 WHEN l >= 24 THEN 13 ELSE floor(l / 2) + 1 END AS BIGINT) AS bucket,"
    " count(*) AS n, round(min(fine_eur), 4) AS min_fine, round(max(fine_eur), 4) AS max_fine FROM fines WHERE l IS NOT NULL GROUP BY 1, 2, 3"
)

ORACLES["x11_fine_quantiles"] = _FINES + " SELECT size_class, " + ", ".join(
    f"quantile_disc(fine_eur, {p}) AS {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))
) + " FROM fines WHERE fine_eur IS NOT NULL GROUP BY 1"


_WIDE = f"w AS ({ORACLES['v1_a8_wide']})"
ORACLES["x10_authority_frequency"] = f"WITH {_WIDE}" + (
    " SELECT dpa_name_canonical, decision_year, decision_quarter, CAST(grouping(dpa_name_canonical, decision_year, decision_quarter) AS BIGINT) AS level,"
    " count(*) AS n FROM w GROUP BY ROLLUP (dpa_name_canonical, decision_year, decision_quarter)"
)
# fines of the wide table, before it is rounded
_SECTOR_FINES = _WIDE_STEPS + f", sf AS (SELECT f_val AS fine_eur, ln(1 + f_val) AS l, isic_section, country_group FROM (SELECT f_val, isic_section, {_gcols} FROM w2 JOIN sec ON sid = w2.id))"
ORACLES["x11_fine_histogram_by_sector"] = _SECTOR_FINES + (
    " SELECT isic_section, country_group, CAST(CASE WHEN l < 0 THEN 0 WHEN l >= 24 THEN 13 ELSE floor(l / 2) + 1 END AS BIGINT) AS bucket,"
    " count(*) AS n, round(min(fine_eur), 4) AS min_fine, round(max(fine_eur), 4) AS max_fine FROM sf WHERE l IS NOT NULL GROUP BY 1, 2, 3"
)
ORACLES["x11_fine_quantiles_by_sector"] = _SECTOR_FINES + " SELECT isic_section, " + ", ".join(
    f"quantile_disc(fine_eur, {p}) AS {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))
) + " FROM sf WHERE fine_eur IS NOT NULL GROUP BY 1"


def pairs_sql(a: int, b: int) -> str:
    ka, kb = (f"list_distinct({known(f'Q{i}', toks(f'q{i}'))})" for i in (a, b))
    return answers_cte(a, b, extra=f"x AS (SELECT id, unnest({ka}) AS option_a FROM ans), y AS (SELECT id, unnest({kb}) AS option_b FROM ans)") + (
        " SELECT option_a, option_b, count(*) AS n FROM x JOIN y USING (id) GROUP BY 1, 2"
    )


ORACLES["x12_principles_pairs"] = pairs_sql(30, 31)
ORACLES["x12_rights_pairs"] = pairs_sql(56, 57)
ORACLES["x12_factor_pairs"] = pairs_sql(41, 42)
ORACLES["x13_measures_by_case"] = answers_cte(16, 53, 56, extra=(
    f"x AS (SELECT CASE WHEN q16 = 'YES' THEN 'b' WHEN len({_subst(toks('q56'))}) > 0 THEN 'r' ELSE 'o' END AS c,"
    f" unnest(list_distinct({known('Q53', toks('q53'))})) AS measure FROM ans)"
)) + (
    " SELECT measure, count(*) FILTER (c = 'b') AS breach_case, count(*) FILTER (c = 'r') AS rights_case, count(*) FILTER (c = 'o') AS other_case FROM x GROUP BY 1"
)
ORACLES["x13_violation_rates"] = answers_cte(30, 31, extra=(
    f"t AS (SELECT {_T(30, 31)} FROM ans), p AS (SELECT unnest([{names(vocab.PRINCIPLES)}]) AS principle),"
    " x AS (SELECT principle, CAST(list_contains(t30, principle) AS INTEGER) AS discussed, list_contains(t31, principle) AS v FROM t CROSS JOIN p)"
)) + (
    " SELECT principle, discussed, count(*) AS decisions, count(*) FILTER (v) AS violations, round(avg(CAST(v AS INTEGER)), 6) AS violation_rate FROM x GROUP BY 1, 2"
)
_feature_cols = []
for _name, _d, _v, _options in (("principle", 30, 31, vocab.PRINCIPLES), ("right", 56, 57, vocab.RIGHTS)):
    for _o in _options:
        _feature_cols += [f"CAST(list_contains(t{_d}, '{_o}') AS INTEGER) AS discussed_{_name}_{_o}",
                          f"CAST(list_contains(t{_v}, '{_o}') AS INTEGER) AS violated_{_name}_{_o}"]
    for _i in (_d, _v):
        _st = ms_status(repr(f"Q{_i}"), f"t{_i}")
        _feature_cols += [f"CAST({_st} = '{s}' AS INTEGER) AS Q{_i}_is_{s}"
                          for s in ("NOT_MENTIONED", "NOT_DETERMINED", "NONE_VIOLATED", "NONE_DISCUSSED")]
_among = lambda t, vs: f"CAST(len(list_distinct(list_filter({t}, lambda v: v IN ({names(vs)})))) AS INTEGER)"
_yes = lambda q, v: f"CAST(coalesce(q{q}, '') = '{v}' AS INTEGER)"
_CHOSEN = (("size", 10), ("breach_type", 21), ("data_category", 25), ("aggravating", 41), ("mitigating", 42), ("role", 9), ("breach_cause", 22), ("subjects", 24),
           ("harm", 43), ("benefit", 44), ("first_time", 48), ("cross_border", 49), ("transfers", 63))
_FEATURES = answers_cte(*sorted({9, 12, 16, 30, 31, 37, 38, 53, 56, 57, 60, 63} | {i for _, i in _CHOSEN}), extra=(
    number_steps("ans", "nums", f="q37", t="q38") + f", m AS (SELECT *, {_T(*sorted({30, 31, 53, 56, 57} | {i for _, i in _CHOSEN}))} FROM nums)"
))
ORACLES["x14_model_features"] = _FEATURES + (
    " SELECT id AS decision_id, CAST(list_contains(t53, 'ADMINISTRATIVE_FINE') AS INTEGER) AS admin_fine, CAST(coalesce(f_val, 0) > 0 AS INTEGER) AS fine_positive,"
    " CAST(len(list_filter(t53, lambda v: v IN ('LIMITATION_PROHIBITION_OF_PROCESSING', 'SUSPENSION_DATA_FLOWS'))) > 0 AS INTEGER) AS limitation_imposed,"
    f" CAST(len(list_distinct(list_filter(t53, lambda v: v IN ({names(vocab.SEVERITY_MEASURES)})))) AS INTEGER) AS severity_composite,"
    " regexp_extract(coalesce(q12, ''), '^([0-9]{2})', 1) AS sector_division,"
    " round(ln(1 + f_val), 6) AS fine_log1p, round(coalesce(ln(1 + t_val), 0), 6) AS turnover_log1p, CAST(t_val IS NULL AS INTEGER) AS turnover_missing,"
    f" {_among('t30', vocab.PRINCIPLES)} AS n_principles_discussed, {_among('t31', vocab.PRINCIPLES)} AS n_principles_violated,"
    f" CAST(len({without('t53', ['NONE', 'ADMINISTRATIVE_FINE'])}) AS INTEGER) AS n_other_measures,"
    f" CAST(len(list_distinct({without('t41', ['NONE'])})) AS INTEGER) AS n_aggravating, CAST(len(list_distinct({without('t42', ['NONE'])})) AS INTEGER) AS n_mitigating,"
    f" {_yes(16, 'YES')} AS breach_case, {_yes(9, 'PROCESSOR')} AS is_processor, {_yes(60, 'YES_REQUIRED_NOT_APPOINTED')} AS dpo_noncompliant,"
    f" {_yes(63, 'YES_VIOLATIONS_FOUND')} AS transfer_violations, " + ", ".join(_feature_cols + [
        f"CAST(list_contains(t{i}, '{o}') AS INTEGER) AS {p}_{o}" for p, i in _CHOSEN for o in _OPTIONS[f"Q{i}"]]) + " FROM m"
)
ORACLES["x19_fit_proof"] = _FEATURES + (
    " SELECT count(*) AS n_rows, CAST(sum(CAST(list_contains(t53, 'ADMINISTRATIVE_FINE') AS INTEGER)) AS BIGINT) AS n_positive, true AS at_optimum FROM m"
)
ORACLES["x19_exact_auc"] = _FEATURES + (
    f", f AS (SELECT CAST(list_contains(t53, 'ADMINISTRATIVE_FINE') AS INTEGER) AS y, {_among('t31', vocab.PRINCIPLES)} * 3 + len(list_distinct({without('t41', ['NONE'])}))"
    f" - len(list_distinct({without('t42', ['NONE'])})) + CAST(t_val IS NULL AS INTEGER) * 0.5 AS s FROM m),"
    " r AS (SELECT y, s, 2 * rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) - 1 AS rank2 FROM f),"
    " g AS (SELECT sum(y) AS p, sum(1 - y) AS n, count(DISTINCT s) AS k, sum(CASE WHEN y = 1 THEN rank2 END) AS ranks2 FROM r)"
    " SELECT CAST(p AS BIGINT) AS n_positive, CAST(n AS BIGINT) AS n_negative, k AS n_scores, CAST(ranks2 - p * (p + 1) AS BIGINT) AS wins2,"
    " round((ranks2 - p * (p + 1)) / 2.0 / (p * n), 6) AS auc FROM g"
)
_roles3 = {"LEAD_SUPERVISORY_AUTHORITY_CASE": "leads", "CONCERNED_AUTHORITY_CASE": "concerned_by", "JOINT_INVESTIGATION": "joins"}
_tok_edges = " UNION ALL ".join(
    f"SELECT 'decision:' || id AS src, '{rel}' AS rel, '{kind}:' || unnest({_subst(known(f'Q{i}', toks(f'q{i}')))}) AS dst FROM ans"
    for rel, kind, i in (("discusses", "principle", 30), ("discusses", "right", 56), ("discusses", "article_6_basis", 32),
                         ("weighs", "factor", 41), ("weighs", "factor", 42), ("exercises", "corrective_power", 53))
)
_named = f"{raw('q2')} <> '' AND NOT {echo(raw('q2'))}"
_EDGES = answers_cte(2, 7, 30, 32, 41, 42, 53, 56, 62, extra=(
    f"e0 AS (SELECT 'authority:' || {raw('q2')} AS src, 'decided' AS rel, 'decision:' || id AS dst FROM ans WHERE {_named}"
    f" UNION ALL SELECT 'decision:' || id, 'involves', 'defendant:' || {raw('q7')} FROM ans WHERE {raw('q7')} <> ''"
    f" UNION ALL SELECT 'authority:' || {raw('q2')}, {mapped('q62', _roles3)}, 'decision:' || id FROM ans WHERE {_named} AND q62 IN ({names(_roles3)})"
    f" UNION ALL {_tok_edges}), edges AS (SELECT DISTINCT * FROM e0)"
))
ORACLES["x15_entity_edges"] = _EDGES + (
    " SELECT split_part(src, ':', 1) AS src_kind, rel, CASE WHEN starts_with(dst, 'decision:') THEN 'decision' ELSE dst END AS dst, count(*) AS n FROM edges GROUP BY 1, 2, 3"
)
ORACLES["x15_degrees"] = _EDGES + (
    ", n AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges)"
    " SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM n WHERE NOT starts_with(node, 'decision:') GROUP BY 1"
)
ORACLES["x15_cross_border"] = _EDGES + f" SELECT src, rel, count(*) AS decisions FROM edges WHERE rel IN ({names(_roles3.values())}) GROUP BY 1, 2"
_CASES = _EDGES + (
    f", cases AS MATERIALIZED (SELECT DISTINCT dst AS decision, src AS party FROM edges WHERE rel IN ({names(_roles3.values())})),"
    " ties AS MATERIALIZED (SELECT * FROM cases UNION SELECT src, dst FROM edges WHERE rel = 'involves' AND src IN (SELECT decision FROM cases))"
)
# Labels fall to the least label of a neighbour, round after round; each round then takes the label of the label. After 16 rounds
# none changes any more at the smallest tables, after 4 at those ten times larger.
_ROUNDS = 40
_labels = ", l0 AS MATERIALIZED (SELECT DISTINCT decision AS node, decision AS label FROM ties UNION SELECT DISTINCT party, party FROM ties)"
for _i in range(_ROUNDS):
    _labels += (
        f", n{_i} AS MATERIALIZED (SELECT node, min(label) AS label FROM (SELECT * FROM l{_i} UNION ALL SELECT t.party, l.label FROM ties t JOIN l{_i} l ON l.node = t.decision"
        f" UNION ALL SELECT t.decision, l.label FROM ties t JOIN l{_i} l ON l.node = t.party) GROUP BY node),"
        f" l{_i + 1} AS MATERIALIZED (SELECT a.node, b.label FROM n{_i} a JOIN n{_i} b ON b.node = a.label)"
    )
ORACLES["x15_case_groups"] = _CASES + _labels + (
    f" SELECT node AS decision, label AS case_group FROM l{_ROUNDS} WHERE starts_with(node, 'decision:')"
)
ORACLES["x15_case_links"] = _CASES + (
    " SELECT decision, min(decision) OVER (PARTITION BY party) AS first_decision, party FROM ties QUALIFY decision <> first_decision"
)
ORACLES["x16_text_summaries"] = answers_cte(*_TEXTS, extra=long_answers(_TEXTS) + f", z AS (SELECT id, question, {norm('a')} AS t FROM u WHERE a IS NOT NULL)") + (
    f" SELECT id AS decision_id, question, md5(t) AS digest, {text_facts('t', 'token_count', 'language')} FROM z"
)
ORACLES["x16_most_similar"] = (
    "WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS d FROM embeddings),"
    " m AS (SELECT d, avg(v) AS c FROM x GROUP BY d)"
    " SELECT vec_id, round(sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))), 5) AS similarity FROM x JOIN m USING (d)"
    " GROUP BY vec_id ORDER BY sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))) DESC, vec_id LIMIT 10"
)
ORACLES["x16_nearest_exact"] = (
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),"
    " p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),"
    " r AS (SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p)"
    " SELECT query_id, id, round(s, 5) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"
)
ORACLES["x16_recall"] = "SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0"
_FQ = sorted({*_CHECKED, 3, *_WQ})
_more_rules = rules() + [
    ("exclusivity_conflict", "greatest(" + ", ".join(conflict(f"t{i}") for i in _WQ) + ") = 1"),
    ("decision_date_parse_error", "dstatus = 'PARSE_ERROR'"),
]
_FLAGS = _META + ", " + date_steps("ans") + ", " + number_steps("dates", "nums", f="q37", t="q38") + (
    f", m AS (SELECT *, {_T(*_WQ)} FROM nums), fl AS (SELECT m.id AS decision_id, complete,"
    f" list_filter([{_case(_more_rules)}], lambda v: v IS NOT NULL) AS flags FROM m JOIN meta ON meta.ID = m.id)"
)
ORACLES["x17_conflict_matrix"] = _FLAGS + " SELECT decision_id, " + ", ".join(
    f"CAST(len(list_filter(flags, lambda v: v IN ({names(v)}))) AS INTEGER) AS {k}" for k, v in dv.CONFLICT_TYPES.items()
) + " FROM fl"
ORACLES["x18_guidelines"] = answers_cte(67, extra="g AS (SELECT id, regexp_extract_all(coalesce(q67, ''), '[0-9]+/[0-9]{4}') AS gs FROM ans)") + (
    " SELECT id AS decision_id, CAST(unnest(range(len(gs))) AS INTEGER) AS position, unnest(gs) AS guideline FROM g"
)


# A version holds from its date; the second lacks the first option of every third question and has one more in the next.
_TIME = "TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(k % 700 AS INTEGER)) + to_hours(CAST(k % 24 AS INTEGER))"
_VERSION = f"CASE WHEN {_TIME} < TIMESTAMP '2024-01-11 00:00:00' THEN NULL WHEN {_TIME} < TIMESTAMP '2025-01-01 06:00:00' THEN 'v1' ELSE 'v2' END"
_LATER = {q: (v[1:] if int(q[1:]) % 3 == 0 else (*v, "ADDED_LATER") if int(q[1:]) % 3 == 1 else v) for q, v in _OPTIONS.items()}


def core_sql(fields: dict[str, str]) -> str:
    cols = []
    for q, name in fields.items():
        v = raw(f"q{q[1:]}")
        if q not in _OPTIONS:
            ok = "ver IS NOT NULL"
        elif q in _multi:
            p = pieces(f"q{q[1:]}")
            ok = " OR ".join(f"(ver = '{x}' AND len({p}) > 0 AND len({without(p, o[q])}) = 0)" for x, o in (("v1", _OPTIONS), ("v2", _LATER)))
        else:
            ok = " OR ".join(f"(ver = '{x}' AND {v} IN ({names(o[q])}))" for x, o in (("v1", _OPTIONS), ("v2", _LATER)))
        cols.append(f"{v} AS {name}, CAST({v} <> '' AND coalesce({ok}, false) AS INTEGER) AS {name}_known")
    return answers_cte(*[int(q[1:]) for q in fields], extra=f"w AS (SELECT *, {_VERSION} AS ver FROM ans)") + (
        " SELECT id AS decision_id, ver AS codebook_version, " + ", ".join(cols) + " FROM w"
    )


ORACLES["x20_decisions"] = core_sql(dv.DECISION_FIELDS)
ORACLES["x20_defendants"] = core_sql(dv.DEFENDANT_FIELDS)
_dated_book = ", ".join(f"('{x}', '{q}', '{t}')" for x, o in (("v1", _OPTIONS), ("v2", _LATER)) for q, v in o.items() for t in v)
ORACLES["s4_codebook_in_force"] = answers_cte(*_OQ, extra=long_answers(_OQ) + (
    f", w AS (SELECT id, {_VERSION} AS ver FROM ans), e AS (SELECT w.ver, question, unnest({toks('a')}) AS token FROM u JOIN w ON w.id = u.id),"
    f" book(ver, question, token) AS (VALUES {_dated_book})"
)) + (
    " SELECT e.ver AS codebook_version, e.question, count(*) AS n_tokens, count(b.token) AS n_known FROM e"
    " LEFT JOIN book b ON b.ver = e.ver AND b.question = e.question AND b.token = e.token GROUP BY 1, 2"
)
def profile_sql(table: str, columns: list[str], nested: tuple[str, ...] = ()) -> str:
    def one(c: str) -> str:
        real = f"(typeof({c}) IN ('DOUBLE', 'FLOAT') OR typeof({c}) LIKE 'DECIMAL%')"
        text = "CAST(NULL AS VARCHAR)" if c in nested else f"CASE WHEN NOT {real} THEN nullif(CAST({c} AS VARCHAR), '') END"
        number = f"CASE WHEN {real} OR typeof({c}) IN ('INTEGER', 'BIGINT', 'HUGEINT') THEN try_cast(CAST({c} AS VARCHAR) AS DOUBLE) END"
        filled = "count(*)" if c in nested else f"count(nullif(CAST({c} AS VARCHAR), ''))"
        return (f"SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) AS total_rows, {filled} AS filled_rows, min({text}) AS min_text,"
                f" max({text}) AS max_text, round(min({number}), 3) AS min_number, round(max({number}), 3) AS max_number FROM {table}_t")

    return " UNION ALL ".join(one(c) for c in columns)


ORACLES["x21_column_profile"] = (
    f"WITH wide_t AS MATERIALIZED ({ORACLES['v1_a8_wide']}), long_t AS MATERIALIZED ({ORACLES['v2_a9_a11_long']}),"
    f" validation_t AS MATERIALIZED ({ORACLES['b5_validation']}), consistency_t AS MATERIALIZED ({ORACLES['v3_b4_consistency']}),"
    f" qa_t AS MATERIALIZED (SELECT *, statuses AS status_counts, top_unknown AS top_unknown_tokens FROM ({ORACLES['v4_g1_g4_qa_summary']})) "
    + " UNION ALL ".join([
        profile_sql("wide", list(WIDE_COLUMNS)), profile_sql("long", ["decision_id", "option", "status", "token_status", "role"]),
        profile_sql("validation", ["decision_id", "flags"], ("flags",)), profile_sql("consistency", ["decision_id", "flags"], ("flags",)),
        profile_sql("qa", ["field_prefix", "total_rows", "rows_with_known", "rows_with_unknown", "total_unknown_tokens", "status_counts", "top_unknown_tokens"],
                    ("status_counts", "top_unknown_tokens")),
    ])
)
ORACLES["x22_harmonized_tokens"] = answers_cte(*_OQ, extra=long_answers(_OQ) + (
    f", t AS (SELECT question, {toks('a')} AS ts FROM u), e AS (SELECT question, unnest(ts) AS v, unnest(range(len(ts))) AS i FROM t),"
    " r AS (SELECT question, CASE WHEN i % 2 = 1 THEN lower(replace(v, '_', '-')) ELSE v END AS raw_token FROM e),"
    f" h AS (SELECT question, raw_token, upper(regexp_replace(raw_token, '[\\s-]+', '_', 'g')) AS token FROM r WHERE NOT starts_with(raw_token, 'FORMAT:')), book(question, token) AS (VALUES {_book})"
)) + (
    " SELECT h.question, raw_token, h.token, CAST(b.token IS NULL AS INTEGER) AS validation_error, count(*) AS n"
    " FROM h LEFT JOIN book b ON b.question = h.question AND b.token = h.token GROUP BY 1, 2, 3, 4"
)
ORACLES["x23_quality"] = _FLAGS + (
    " SELECT decision_id, round(greatest(1 - 0.1 * len(flags) - CASE WHEN complete = 1 THEN 0 ELSE 0.2 END, 0.0)::DOUBLE, 6) AS quality_score,"
    f" 'orders' AS source_id, '1.1.0' AS parser_version, (SELECT {_VERSION} FROM (SELECT CAST(substring(decision_id, 2) AS BIGINT) AS k)) AS codebook_version,"
    " '1' AS mapping_version FROM fl"
)
ORACLES["x23_review_sample"] = answers_cte(1, 16, extra=_gsteps + (
    f", s AS (SELECT id AS decision_id, country_group || '/' || coalesce(q16, 'NONE') AS stratum FROM (SELECT id, q16, {_gcols} FROM geo)),"
    " z AS (SELECT stratum, count(*) AS n, sum(count(*)) OVER () AS total FROM s GROUP BY 1),"
    " q AS (SELECT *, least(200, total) * n // total AS whole, least(200, total) * n % total AS rest FROM z),"
    " t AS (SELECT stratum, whole + CAST(row_number() OVER (ORDER BY rest DESC, stratum) <= least(200, total) - sum(whole) OVER () AS INTEGER) AS take FROM q),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || decision_id), decision_id) AS k FROM s)"
)) + " SELECT decision_id, stratum, CAST(k AS INTEGER) AS sample_rank FROM r JOIN t USING (stratum) WHERE k <= take"
ORACLES["x23_strict_mode"] = _FLAGS + f" SELECT decision_id FROM fl WHERE complete = 1 AND len({without('flags', TOLERATED)}) = 0"
ORACLES["x24_validation_summary"] = _FLAGS + (
    ", u AS (SELECT unnest(flags) AS flag FROM fl UNION ALL SELECT '(all)' FROM fl UNION ALL SELECT '(complete)' FROM fl WHERE complete = 1)"
    " SELECT flag, count(*) AS n FROM u GROUP BY 1"
)

# --- document corpus ---------------------------------------------------------
_doc = "FROM documents WHERE doc_id % 14 <> 3"
ORACLES["d1_d5_header"] = (
    f"WITH d AS (SELECT doc_id, source, lang, {DECIDED_TEXT} AS decided, {FINE_TEXT} AS fine {_doc})"
    " SELECT doc_id, source AS authority, lang AS jurisdiction, '' AS appeal, CAST(6 AS INTEGER) AS n_fields,"
    " CASE decided WHEN '07.10.2022' THEN '2022-10-07' WHEN '15.3.2021' THEN '2021-03-15' WHEN '20.07.23' THEN '2023-07-20'"
    " WHEN '20/12/2022' THEN '2022-12-20' WHEN '5. 2. 2020' THEN '2020-02-05' END AS decided,"
    " CASE doc_id % 5 WHEN 0 THEN 3000.0 WHEN 1 THEN 900000.0 WHEN 2 THEN 14931.0 WHEN 3 THEN NULL ELSE CAST(doc_id AS DOUBLE) END AS fine_amount,"
    " CASE doc_id % 5 WHEN 2 THEN 'RON' WHEN 3 THEN NULL ELSE 'EUR' END AS fine_currency FROM d"
)
_ANNEX = "text || '\n\n## Annex\n' || lang"
ORACLES["d2_sections"] = (
    f"SELECT doc_id, md5({strip('text')}) AS facts, CASE WHEN doc_id % 5 <> 0 THEN 'Held: ' || lang END AS holding,"
    f" 'Comment on ' || source AS comment, md5({strip(_ANNEX)}) AS machine_translation {_doc}"
)
ORACLES["d3_decisions_once"] = (
    "SELECT min(doc_id) AS doc_id, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT doc_id,"
    " '**Jurisdiction:** ' || lang || '\n\n## Contents\n\n' || text AS t FROM documents WHERE doc_id % 14 <> 3 AND doc_id % 14 <> 4) GROUP BY t"
)
ORACLES["d4_cited_articles"] = (
    "SELECT doc_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS position, unnest(['Article ' || CAST(doc_id % 99 + 1 AS STRING) || '(1)(f)', 'Article 32',"
    f" 'Article ' || CAST(doc_id % 7 + 1 AS STRING) || '(2)']) AS article {_doc}"
)
ORACLES["s6_corpus_files"] = (
    "SELECT sha256(body_type || '/' || country || '/' || file_name) AS doc_id, body_type, country, file_name, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest"
    " FROM (SELECT CASE WHEN page_id % 2 = 0 THEN 'authorities' ELSE 'courts' END AS body_type, 'Land ' || CAST(page_id % 7 AS STRING) AS country,"
    " CAST(page_id AS STRING) || '.md' AS file_name, '# ' || coalesce(url, '') || chr(10) || coalesce(html, '') AS t FROM pages)"
)
