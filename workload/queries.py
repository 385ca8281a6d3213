"""The registered queries: each operator over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import vocab
from caseloom.codebook import Codebook
from caseloom.functions import tokens as tk
from caseloom.functions import typed as ty
from caseloom.functions.text import language_guess, normalize_text, token_count
from caseloom.operators import (
    authorities, checks, codebooks, corpus, derived, enrich, frequency, graph, long, matrices, model, neighbours, parse, profiles, qa,
    retrieval, sampling, tokens,
    wide,
)
from caseloom.plans import publish
from caseloom.plans.run import parse_block_files, read_run, run_all
from caseloom.sources import blocks, readers, sinks
from caseloom.sources.ranges import file_system
from caseloom.sources.shared import fresh_path
from caseloom.streaming import incremental
from workload.answers import responses, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BOOK = Codebook.default()


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def scratch(spark: SparkSession, name: str) -> str:
    return fresh_path(spark, name)


_LANDED: dict[tuple[str, str], str] = {}


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed records, landed as Parquet once per application and read back."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDED:
        path = scratch(spark, "parsed")
        parse.parse_records(responses(spark, sf_dir)).write.parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])


def joined(c: Column | str, sep: str = ",") -> Column:
    return F.array_join(c, sep)


def answers(q: str) -> Column:
    return F.col("answers")[q]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles cut for the comparison: amounts to four digits, the rest to six."""
    digits = {c: 4 if c.endswith("_eur") else 6 for c, t in df.dtypes if t == "double"}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# --- parsing -----------------------------------------------------------------
@query
def p2_parse_answers(spark, sf_dir):
    rows = parse.parse_answers(responses(spark, sf_dir))
    keys = [f"Q{i}" for i in range(1, 70)] + ["Q01"]
    return tk.answer_columns(rows, {k: k for k in keys}, "ID")


@query
def p3_parse_metadata(spark, sf_dir):
    m = F.col("metadata")
    return parse.parse_answers(responses(spark, sf_dir)).select(
        "ID", m["line_count"].alias("line_count"), m["completeness"].cast("int").alias("complete"),
        m["question_count"].alias("question_count"), joined(m["missing_questions"]).alias("missing"),
        joined(m["warnings"]).alias("warnings"), m["parser_version"].alias("parser_version"),
    )


def blobs(spark, sf_dir, preamble: bool = True) -> DataFrame:
    """Every document becomes concatenated answer blocks of up to five lines each."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def numbered(line: Column, i: Column) -> Column:
        block = F.floor(i / 5)
        start = F.when(i % 5 != 0, F.concat(F.lit("Answer "), (i % 5 + 1).cast("string"), F.lit(": ")))
        for case, mark in enumerate(["Answer 1: ", '"Answer 1: ', "Answer  1: "]):
            start = start.when((F.col("doc_id") + block) % 4 == case, mark)
        return F.concat(start.otherwise("Answer 1:"), line)

    body = F.array_join(F.transform(F.split("text", "\n"), numbered), "\n")
    lead = F.when(F.lit(preamble) & (F.col("doc_id") % 3 == 0), "Preamble, not a block\n").otherwise("")
    return docs.select("doc_id", F.concat(lead, body).alias("value"))


@query
def p1_segment_blocks(spark, sf_dir):
    return parse.segment_blocks(blobs(spark, sf_dir)).select(
        "doc_id", "record_index", F.length("response").alias("n_chars"), F.md5("response").alias("digest")
    )


#: Small, so that each file of the test tables is read in several ranges.
RANGE_BYTES = 1 << 16


def block_files(spark, sf_dir) -> str:
    """A folder of files of concatenated blocks: eight files, their documents in order."""
    path = scratch(spark, "blocks")
    rows = blobs(spark, sf_dir, preamble=False).withColumn("part", F.col("doc_id") % 8)
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    return path


def part_of(source: Column) -> Column:
    return F.regexp_extract(source, "part=([0-9]+)", 1).cast("int")


@query
def s2_block_files(spark, sf_dir):
    rows = blocks.responses(readers.read_answer_blocks(spark, block_files(spark, sf_dir), RANGE_BYTES))
    return rows.select(part_of(F.col("source")).alias("part"), "record_index", F.length("response").alias("n_chars"), F.md5("response").alias("digest"))


@query
def v5_k6_parse_blocks(spark, sf_dir):
    """Parsed records written as JSON lines and read back."""
    path = scratch(spark, "records")
    sinks.write_records(parse_block_files(spark, block_files(spark, sf_dir), RANGE_BYTES), path)
    schema = ("record_index int, ingestion_timestamp timestamp, answers map<string,string>,"
              " metadata struct<line_count:int,completeness:boolean,question_count:int,missing_questions:array<string>,warnings:array<string>,parser_version:string>")
    a, m = F.col("answers"), F.col("metadata")
    lines = F.transform(F.array_sort(F.map_keys(a)), lambda k: F.concat(k, F.lit("="), a[k]))
    return spark.read.schema(schema).json(path).select(
        "record_index", F.col("ingestion_timestamp").isNotNull().alias("timed"), m["question_count"].alias("question_count"), m["line_count"].alias("line_count"),
        m["completeness"].cast("int").alias("complete"), F.size(m["missing_questions"]).alias("n_missing"), F.size(m["warnings"]).alias("n_warnings"),
        m["parser_version"].alias("parser_version"), F.md5(F.array_join(lines, "\n")).alias("digest"),
    )


@query
def s1_master_csv(spark, sf_dir):
    """All answers of a master file that several tasks read."""
    path = scratch(spark, "master")
    responses(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    rows = parse.parse_answers(readers.read_master_csv(spark, path, 16 * RANGE_BYTES))
    return tk.answer_columns(rows, {f"Q{i}": f"Q{i}" for i in range(1, 69)}, "ID", F.col("metadata.question_count").alias("question_count"))


# --- typed scalars -----------------------------------------------------------
@query
def f1_f2_dates(spark, sf_dir):
    d = ty.clean_date(answers("Q3"))
    staged = parsed(spark, sf_dir).select("ID", d.alias("d"))
    day = F.col("d.value")
    return staged.select(
        "ID", F.col("d.raw").alias("raw"), day.cast("string").alias("value"), F.col("d.status").alias("status"),
        F.col("d.error").alias("error"), ty.iso_timestamp(day).alias("iso"),
        F.year(day).alias("year"), ty.quarter_label(day).alias("quarter"),
    )


@query
def f3_f4_j3_country(spark, sf_dir):
    c = ty.clean_country(answers("Q1"))
    return parsed(spark, sf_dir).select("ID", c.alias("c")).select("ID", *ty.country_columns(F.col("c")))


@query
def f5_f6_numbers(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(q).alias("question"), answers(q).alias("a")) for q in ("Q37", "Q38")])
    rows = parsed(spark, sf_dir).select("ID", F.explode(cells).alias("x")).select("ID", "x.*")
    n = rows.withColumn("n", ty.clean_number(F.col("a")))
    return n.select("ID", "question", "n.raw", ty.sanitize_number(F.col("n.raw")).alias("sanitized"),
                    F.round("n.value", 4).alias("value"), "n.status", F.col("n.valid").cast("int").alias("valid"), "n.error")


@query
def f7_f8_money(spark, sf_dir):
    rows = parsed(spark, sf_dir).select(
        "ID", ty.clean_number(answers("Q37")).alias("f"), ty.clean_number(answers("Q38")).alias("t")
    ).select("ID", *ty.money_columns(F.col("f"), "fine", vocab.FINE_OUTLIER),
             *ty.money_columns(F.col("t"), "turnover", vocab.TURNOVER_OUTLIER),
             ty.fine_ratio(F.col("f.value"), F.col("t.value")).alias("fine_to_turnover_ratio"))
    return rounded(rows)


@query
def f9_f10_f15_text(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    raw = F.concat(F.lit("  cafe\u0301 \u00a0"), F.col("text"), F.lit(" \u2003 x\u200by\ufeff \u00a0"))
    return docs.select("doc_id", normalize_text(raw).alias("t")).select(
        "doc_id", F.md5("t").alias("digest"), F.length("t").alias("n_chars"), token_count(F.col("t")).alias("n_tokens"),
        language_guess(F.col("t")).alias("language"),
    )


@query
def f11_f14_flags(spark, sf_dir):
    return parsed(spark, sf_dir).select(
        "ID", *wide.ingest_columns(), *wide.authority_columns(answers("Q2")),
        *wide.echo_columns(answers("Q2"), answers("Q12")),
        answers("Q16").eqNullSafe("YES").cast("int").alias("breach_case"),
    )


# --- multi-select ------------------------------------------------------------
@query
def a1_a5_multiselect(spark, sf_dir):
    cells = tk.answer_list(F.col("answers"), [q for q, _ in vocab.WIDE_FIELDS])
    rows = parsed(spark, sf_dir).select("ID", F.explode(cells).alias("x")).select("ID", "x.question", F.col("x.answer").alias("a"))
    t = F.col("t")
    return rows.withColumn("t", tk.answer_tokens(F.col("a"))).select(
        "ID", "question", F.size(tk.split_tokens(F.col("a"))).alias("n_raw"), joined("t").alias("tokens"),
        joined(F.array_distinct("t")).alias("distinct_tokens"),
        tk.multiselect_status(F.col("question"), t).alias("status"), tk.exclusivity_conflict(t).alias("conflict"),
    )


@query
def a6_a7_measures(spark, sf_dir):
    staged = parsed(spark, sf_dir).select(
        "ID", *[BOOK.known(q, tk.answer_tokens(answers(q))).alias(q) for q in ("Q30", "Q31", "Q53")],
        ty.clean_number(answers("Q37"))["value"].alias("fine"),
    )
    return staged.select("ID", *wide.measure_columns(F.col("Q30"), F.col("Q31"), F.col("Q53"), F.col("fine")))


def sector_listing(spark, sf_dir) -> DataFrame:
    """A sector list derived from ``part``: letters open sections, codes repeat."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"),
        F.expr("CASE WHEN p_partkey % 40 = 0 THEN chr(CAST(65 + floor(p_partkey / 40) % 26 AS INT))"
               " WHEN p_partkey % 40 = 1 THEN lpad(CAST(CAST(floor(p_partkey / 40) AS BIGINT) % 100 AS STRING), 2, '0')"
               " ELSE '\"' || lpad(CAST(p_partkey * 7 % 10000 AS STRING), 4, '0') || '\"' END").alias("code"),
        F.concat(F.lit(" "), F.col("p_name"), F.lit(" "), F.col("p_type")).alias("description"),
    )


def sectors(spark, sf_dir) -> DataFrame:
    return enrich.sector_dimension(sector_listing(spark, sf_dir))


@query
def w1_s5_sector_sections(spark, sf_dir):
    return sectors(spark, sf_dir)


@query
def j2_sector_lookup(spark, sf_dir):
    rows = parsed(spark, sf_dir).select("ID", F.coalesce(answers("Q12"), F.lit("")).alias("sector"))
    return enrich.sector_lookup(rows, sectors(spark, sf_dir), "sector")


OPTION_QUESTIONS = sorted(BOOK.options, key=lambda q: int(q[1:]))


def token_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct tokens with their counts: what is joined with a vocabulary is then no larger than it is varied."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


@query
def j1_validate_tokens(spark, sf_dir):
    """All questions with options."""
    rows = tokens.token_totals(parsed(spark, sf_dir), OPTION_QUESTIONS)
    return tokens.validate_tokens_long(rows, BOOK.to_frame(spark)).select("question", "token", "token_status", "n")


@query
def j1_known_and_unknown(spark, sf_dir):
    rows = tokens.question_tokens(parsed(spark, sf_dir), [q for q, _ in vocab.WIDE_FIELDS])
    book = BOOK.to_frame(spark)
    known = tokens.known_tokens(rows, book).groupBy("question").agg(F.count("*").alias("n")).withColumn("side", F.lit("known"))
    unknown = tokens.unknown_tokens(rows, book).groupBy("question").agg(F.count("*").alias("n")).withColumn("side", F.lit("unknown"))
    return known.unionByName(unknown)


# --- tables and reports ------------------------------------------------------
@query
def v1_a8_wide(spark, sf_dir):
    rows = wide.clean_wide(parsed(spark, sf_dir), BOOK, sectors(spark, sf_dir))
    return rounded(rows).withColumn("decision_date", F.col("decision_date").cast("string"))


@query
def v2_a9_a11_long(spark, sf_dir):
    return long.emit_long(parsed(spark, sf_dir), BOOK)


@query
def v3_b4_consistency(spark, sf_dir):
    return checks.check_consistency(parsed(spark, sf_dir)).select("decision_id", joined("flags", ";").alias("flags"))


@query
def b5_validation(spark, sf_dir):
    return wide.validate(parsed(spark, sf_dir)).select("decision_id", joined("flags", ";").alias("flags"))


def landed_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table as the summary reads it: written once, then scanned."""
    key = (spark.sparkContext.applicationId, f"wide:{sf_dir}")
    if key not in _LANDED:
        path = scratch(spark, "wide")
        sinks.write_wide(wide.clean_wide(parsed(spark, sf_dir), BOOK), path)
        _LANDED[key] = path
    return spark.read.parquet(_LANDED[key])


def summary_rows(summary: DataFrame) -> DataFrame:
    pairs = lambda c, k, v: joined(F.transform(c, lambda e: F.concat(e[k], F.lit("="), e[v].cast("string"))), ";")
    return summary.select(
        "field_prefix", "total_rows", "rows_with_known", "rows_with_unknown", "total_unknown_tokens",
        pairs(F.map_entries("status_counts"), "key", "value").alias("statuses"),
        pairs(F.col("top_unknown_tokens"), "token", "n").alias("top_unknown"),
    )


@query
def v4_g1_g4_qa_summary(spark, sf_dir):
    return summary_rows(qa.qa_summary(landed_wide(spark, sf_dir)))


@query
def g2_status_counts(spark, sf_dir):
    return qa.status_counts(landed_wide(spark, sf_dir))


@query
def g3_top_unknown(spark, sf_dir):
    return qa.top_unknown_tokens(landed_wide(spark, sf_dir), 3)


_RUNS: dict[tuple[str, str], str] = {}


def published(spark, sf_dir):
    """The tables of a whole run, published once per application and read back by its manifest."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        out = scratch(spark, "run")
        run_all(spark, responses(spark, sf_dir), out, BOOK, sectors(spark, sf_dir))
        _RUNS[key] = out
    return read_run(spark, publish.current(_RUNS[key]))


@query
def v6_run_all(spark, sf_dir):
    tables = published(spark, sf_dir)
    counts = [
        ("parsed", tables.parsed), ("wide", tables.wide), ("validation", tables.validation),
        ("long", tables.long), ("consistency", tables.consistency), ("qa", tables.qa),
    ]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in counts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def v6_k1_wide(spark, sf_dir):
    return rounded(published(spark, sf_dir).wide).withColumn("decision_date", F.col("decision_date").cast("string"))


@query
def v6_k2_validation(spark, sf_dir):
    return published(spark, sf_dir).validation.select("decision_id", joined("flags", ";").alias("flags"))


@query
def v6_k3_long(spark, sf_dir):
    return published(spark, sf_dir).long


@query
def v6_k4_consistency(spark, sf_dir):
    return published(spark, sf_dir).consistency.select("decision_id", joined("flags", ";").alias("flags"))


@query
def v6_k5_qa_summary(spark, sf_dir):
    return summary_rows(published(spark, sf_dir).qa)


# --- streams -----------------------------------------------------------------
def event_stream(spark, sf_dir) -> DataFrame:
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def event_responses(events: DataFrame) -> DataFrame:
    """Events as arriving answer blocks: one decision per event."""
    return events.select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("ID"),
        F.col("ts").alias("ingestion_timestamp"),
        F.concat_ws(
            "\n",
            F.lit("Answer 1: ISO_3166-1_ALPHA-2: DE"),
            F.concat(F.lit("Answer 30: "), F.when(F.col("event_type") == "error", "NONE_DISCUSSED")
                     .when(F.col("event_type") == "view", "NOT_APPLICABLE, SECURITY").otherwise("SECURITY")),
            F.concat(F.lit("Answer 37: "), F.col("value").cast("decimal(12,2)").cast("string"), F.lit(" \u20ac")),
            F.when(F.col("event_type") != "click", F.lit("Answer 53: ADMINISTRATIVE_FINE")),
        ).alias("response"),
    )


@query
def r1_incremental_parse(spark, sf_dir):
    stream = incremental.parse_stream(event_responses(event_stream(spark, sf_dir)))
    staged = stream.select("ID", ty.clean_number(answers("Q37"))["value"].alias("fine"), answers("Q30").alias("q30"),
                           F.col("metadata.question_count").alias("question_count"))
    path = scratch(spark, "stream")
    incremental.write_available(staged, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(staged.schema).parquet(f"{path}/out")


@query
def r2_drop_redelivered(spark, sf_dir):
    """One delivery per user and event type survives the 60-day horizon."""
    stream = event_stream(spark, sf_dir).select(
        F.concat_ws(":", "user_id", "event_type").alias("decision_id"), F.col("ts").alias("ingestion_timestamp"))
    once = incremental.drop_redelivered(stream, delay="60 days").select("decision_id")
    path = scratch(spark, "stream")
    incremental.write_available(once, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(once.schema).parquet(f"{path}/out")


def event_answer(q: str) -> str:
    """SQL: what an event answers to a multi-select question; both engines evaluate it."""
    first, second = vocab.MULTI_SELECT_OPTIONS[q][:2]
    return (f"CASE (event_id + {q[1:]}) % 5 WHEN 0 THEN NULL WHEN 1 THEN '{first}' WHEN 2 THEN 'NOT_APPLICABLE'"
            f" WHEN 3 THEN '{first}, Odd_' || event_type ELSE '{second}' END")


@query
def r3_running_counts(spark, sf_dir):
    """All sixteen multi-select fields of decisions that arrive as events."""
    lines = [F.concat(F.lit(f"Answer {q[1:]}: "), F.expr(event_answer(q))) for q, _ in vocab.WIDE_FIELDS]
    arrived = event_stream(spark, sf_dir).select(F.col("ts").alias("ingestion_timestamp"), F.concat_ws("\n", *lines).alias("response"))
    rows = parse.parse_answers(arrived)
    cells = []
    for q, prefix in vocab.WIDE_FIELDS:
        t = tk.answer_tokens(answers(q))
        cells += [joined(BOOK.known(q, t)).alias(f"{prefix}_known"), joined(BOOK.unknown(q, t)).alias(f"{prefix}_unknown"),
                  tk.multiselect_status(q, t).alias(f"{prefix}_status")]
    counts = incremental.running_status_counts(rows.select("ingestion_timestamp", *cells))
    path = scratch(spark, "stream")
    latest = incremental.upsert_available(counts, ["window", "field_prefix", "status"], "n", f"{path}/out", f"{path}/checkpoint")
    return latest.select(F.col("window.start").cast("date").cast("string").alias("day"), "field_prefix", "status", "n")


# --- specified analyses ------------------------------------------------------
@query
def x1_option_matrix(spark, sf_dir):
    return matrices.option_matrix(parsed(spark, sf_dir), BOOK)


@query
def x2_missingness_profile(spark, sf_dir):
    return matrices.missingness_profile(matrices.missingness_cells(parsed(spark, sf_dir), BOOK))


@query
def x2_missingness_table(spark, sf_dir):
    return matrices.missingness(parsed(spark, sf_dir), BOOK)


@query
def x3_date_features(spark, sf_dir):
    rows = derived.date_features(parsed(spark, sf_dir), as_of="2025-01-01", first_year=1995)
    return rows.withColumn("decision_date", F.col("decision_date").cast("string"))


@query
def x4_safeguards(spark, sf_dir):
    return derived.safeguards(parsed(spark, sf_dir))


@query
def x5_authority_match(spark, sf_dir):
    names = parsed(spark, sf_dir).select(ty.clean_country(answers("Q1"))["value"].alias("country"), answers("Q2").alias("name"))
    names = names.filter(F.col("country").isNotNull() & F.col("name").isNotNull())
    named = names.withColumn("country", F.upper("country")).filter(~ty.is_schema_echo(F.col("name")))
    registry = authority_registry(spark, sf_dir)
    return authorities.match_authorities(named, registry).withColumn("score", F.round("score", 6))


#: Registry names that differ in few places, and what becomes of them in an answer.
BUREAU = "'Regional Supervisory Office for Data Protection No ' || lpad(CAST(p_partkey * 7919 % 100003 AS STRING), 6, '0') || ' ' || p_brand"
LAND = "chr(CAST(65 + p_partkey % 4 AS INT)) || 'X'"
SPELT = (
    f"CASE p_partkey % 6 WHEN 0 THEN {BUREAU} WHEN 1 THEN upper({BUREAU}) WHEN 2 THEN replace({BUREAU}, 'Office for', 'Ofice of')"
    f" WHEN 3 THEN replace({BUREAU}, '#', '') WHEN 4 THEN replace(replace({BUREAU}, 'Brand', 'Brnd'), 'Protection', 'Protecton') ELSE 'Bureau ' || p_name END"
)


@query
def x5_many_authorities(spark, sf_dir):
    """Hundreds of authorities a country whose names share all but a number and a brand."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"))
    registry = part.select(F.col("p_partkey").alias("authority_id"), F.expr(LAND).alias("country"), F.expr(BUREAU).alias("authority_name"))
    names = part.select(F.expr(LAND).alias("country"), F.expr(SPELT).alias("name"))
    return authorities.match_authorities(names, registry).withColumn("score", F.round("score", 6))


def authority_registry(spark, sf_dir) -> DataFrame:
    """One authority per customer nation, with the country code of that nation."""
    from workload.answers import _CODE

    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    return nations.select(
        F.col("n").cast("long").alias("authority_id"), F.expr(_CODE).alias("country"),
        F.concat(F.lit("Data Protection Office No "), F.col("n").cast("string")).alias("authority_name"),
    )


@query
def x6_country_and_sectors(spark, sf_dir):
    from workload.answers import _CODE

    countries = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).withColumn("n", F.col("n_nationkey")).select(F.expr(_CODE).alias("code"), F.col("r_name").alias("region"), F.col("n_name").alias("languages"))
    rows = parsed(spark, sf_dir).select(
        "ID", F.upper(ty.clean_country(answers("Q1"))["value"]).alias("country_code"),
        enrich.sector_codes(answers("Q12")).alias("s"),
    )
    return enrich.with_country_attributes(rows, countries).select(
        "ID", "country_code", "region", "languages", F.col("s.primary").alias("primary_sector"),
        joined("s.secondary").alias("secondary_sectors"), F.col("s.multi").alias("multi_sector"),
    )


@query
def x7_x8_scales(spark, sf_dir):
    return derived.scales(parsed(spark, sf_dir))


@query
def x9_rollups(spark, sf_dir):
    return derived.rollups(parsed(spark, sf_dir), BOOK)


@query
def x10_frequency_rollup(spark, sf_dir):
    rows = parsed(spark, sf_dir).select(
        ty.clean_country(answers("Q1")).alias("c"), ty.clean_date(answers("Q3"))["value"].alias("day")
    ).select(*ty.country_columns(F.col("c")), F.year("day").alias("decision_year"), ty.quarter_label(F.col("day")).alias("decision_quarter"))
    return frequency.frequency_rollup(rows)


@query
def x10_authority_frequency(spark, sf_dir):
    return frequency.frequency_rollup(published(spark, sf_dir).wide, ("dpa_name_canonical", "decision_year", "decision_quarter"))


@query
def x11_fine_histogram_by_sector(spark, sf_dir):
    h = frequency.fine_histogram(published(spark, sf_dir).wide, ["isic_section", "country_group"])
    return h.withColumns({c: F.round(c, 4) for c in ("min_fine", "max_fine")})


@query
def x11_fine_quantiles_by_sector(spark, sf_dir):
    return frequency.fine_quantiles(published(spark, sf_dir).wide, ["isic_section"])


def fines(spark, sf_dir) -> DataFrame:
    return parsed(spark, sf_dir).select(
        ty.clean_number(answers("Q37"))["value"].alias("fine_eur"),
        F.coalesce(F.try_element_at(derived.substantive(tk.answer_tokens(answers("Q10"))), F.lit(1)), F.lit("UNKNOWN")).alias("size_class"),
        ty.flag(answers("Q49").isin("YES_LEAD_AUTHORITY_CASE", "YES_MULTIPLE_DPAS_INVOLVED")).alias("cross_border"),
    ).withColumn("fine_log1p", F.log1p("fine_eur"))


@query
def x11_fine_histogram(spark, sf_dir):
    h = frequency.fine_histogram(fines(spark, sf_dir), ["size_class", "cross_border"])
    return h.withColumns({c: F.round(c, 4) for c in ("min_fine", "max_fine")})


@query
def x11_fine_quantiles(spark, sf_dir):
    return frequency.fine_quantiles(fines(spark, sf_dir), ["size_class"])


def _pairs_query(name: str, a: str, b: str):
    def run(spark, sf_dir):
        return matrices.co_occurrence(parsed(spark, sf_dir), a, b, BOOK)

    run.__name__ = name
    QUERIES[name] = run


_pairs_query("x12_principles_pairs", "Q30", "Q31")
_pairs_query("x12_rights_pairs", "Q56", "Q57")
_pairs_query("x12_factor_pairs", "Q41", "Q42")


@query
def x13_measures_by_case(spark, sf_dir):
    return matrices.measures_by_case_type(parsed(spark, sf_dir), BOOK)


@query
def x13_violation_rates(spark, sf_dir):
    return matrices.violation_rates(parsed(spark, sf_dir)).withColumn("violation_rate", F.round("violation_rate", 6))


@query
def x14_model_features(spark, sf_dir):
    rows = model.model_features(parsed(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c, t in rows.dtypes if t == "double"})


@query
def x15_entity_edges(spark, sf_dir):
    edges = graph.entity_edges(parsed(spark, sf_dir), BOOK)
    kind = lambda c: F.substring_index(c, ":", 1)
    return edges.groupBy(kind("src").alias("src_kind"), "rel", F.when(kind("dst") == "decision", "decision").otherwise(F.col("dst")).alias("dst")).agg(
        F.count("*").alias("n"))


@query
def x15_degrees(spark, sf_dir):
    d = graph.degrees(graph.entity_edges(parsed(spark, sf_dir), BOOK))
    return d.filter(~F.startswith("node", F.lit("decision:")))


@query
def x15_cross_border(spark, sf_dir):
    return graph.shared_case_roles(graph.entity_edges(parsed(spark, sf_dir), BOOK))


@query
def x15_case_groups(spark, sf_dir):
    return graph.case_groups(graph.entity_edges(parsed(spark, sf_dir), BOOK))


@query
def x15_case_links(spark, sf_dir):
    return graph.case_links(graph.entity_edges(parsed(spark, sf_dir), BOOK))


@query
def x16_text_summaries(spark, sf_dir):
    return retrieval.text_summaries(parsed(spark, sf_dir)).select(
        "decision_id", "question", F.md5("normalized_text").alias("digest"), "token_count", "language")


@query
def x16_most_similar(spark, sf_dir):
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    center = retrieval.mean_vector(vectors, "embedding").select("mean").scalar()
    top = retrieval.most_similar(vectors, center, 10, "vec_id", "embedding")
    return top.withColumn("similarity", F.round("similarity", 5))


def vectors_of(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


_INDEXES: dict[tuple[str, str], neighbours.Index] = {}


def vector_index(spark, sf_dir) -> neighbours.Index:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = neighbours.build_index(vectors_of(spark, sf_dir), "vec_id", "embedding")
    return _INDEXES[key]


@query
def x16_nearest(spark, sf_dir):
    """The ten nearest of every vector, by the index; the nearest of all, being itself, left out."""
    found = neighbours.search(vector_index(spark, sf_dir), vectors_of(spark, sf_dir), 10, "vec_id", "embedding", exclude_self=True)
    return found.select("query_id", "id", F.round("similarity", 5).alias("similarity"), "rank")


def stated(vectors: DataFrame) -> DataFrame:
    return vectors.filter("vec_id % 50 = 0")


@query
def x16_nearest_exact(spark, sf_dir):
    """The vectors with an id divisible by 50, against all rows."""
    rows = vectors_of(spark, sf_dir)
    found = neighbours.nearest_exact(rows, stated(rows), 10, "vec_id", "embedding", exclude_self=True)
    return found.select("query_id", "id", F.round("similarity", 5).alias("similarity"), "rank")


@query
def x16_recall(spark, sf_dir):
    """Whether the index finds nine in ten of the true neighbours."""
    rows = vectors_of(spark, sf_dir)
    exact = neighbours.nearest_exact(rows, stated(rows), 10, "vec_id", "embedding", exclude_self=True)
    found = neighbours.search(vector_index(spark, sf_dir), stated(rows), 10, "vec_id", "embedding", exclude_self=True)
    return neighbours.recall(found, exact).select("n_queries", (F.col("recall") >= 0.9).alias("enough"))


@query
def x17_conflict_matrix(spark, sf_dir):
    return derived.conflict_matrix(derived.all_flags(parsed(spark, sf_dir)))


@query
def x18_guidelines(spark, sf_dir):
    return derived.guidelines(parsed(spark, sf_dir))


@query
def x19_logistic_scores(spark, sf_dir):
    scored = model.score_logistic(model.model_features(parsed(spark, sf_dir)), "admin_fine", PREDICTORS)
    return scored.select("decision_id", "label", F.round("probability", 3).alias("probability"))


PREDICTORS = ["turnover_log1p", "n_principles_violated", "n_principles_discussed", "breach_case", "n_other_measures",
              "aggravating_INTENT_NEGLIGENCE", "mitigating_COOPERATION_WITH_AUTHORITY", "harm_YES_MATERIAL_HARM", "cross_border_NO_SINGLE_JURISDICTION"]


@query
def x19_fit_proof(spark, sf_dir):
    """All predictors that do not leak; the gradient itself is no whole number to compare."""
    return model.fit_proof(model.model_features(parsed(spark, sf_dir))).drop("gradient")


@query
def x19_exact_auc(spark, sf_dir):
    """How well a sum of simple features ranks fined decisions; ties are many."""
    rows = model.model_features(parsed(spark, sf_dir)).select(
        (F.col("n_principles_violated") * 3 + F.col("n_aggravating") - F.col("n_mitigating") + F.col("turnover_missing") * 0.5).alias("score"), "admin_fine")
    return model.exact_auc(rows, "score", "admin_fine").withColumns({"wins2": F.col("wins2").cast("long"), "auc": F.round("auc", 6)})


#: Two questionnaires and when each began to hold; the second drops and adds options by the number of a question.
BOOK_DATES = {"v1": "2024-01-11 00:00:00", "v2": "2025-01-01 06:00:00"}


def book_options(question: str, version: str) -> list[str]:
    listed, n = list(BOOK.allowed(question)), int(question[1:])
    if version == "v2":
        listed = listed[1:] if n % 3 == 0 else [*listed, "ADDED_LATER"] if n % 3 == 1 else listed
    return listed


def questionnaire(spark, version: str) -> DataFrame:
    """The codebook of a version, written as the Markdown questionnaire and read back."""
    text = ["# Questionnaire", ""]
    for n in range(1, vocab.EXPECTED_QUESTIONS + 1):
        q = f"Q{n}"
        kind = BOOK.kinds[q]
        spec = f"{kind}:{','.join(book_options(q, version))}" if q in BOOK.options else "ISO_3166-1_ALPHA-2: AT,BE" if kind == "RAW" else f"{kind}:STRING"
        text += [f"**Question {n}:** ?", f"**Answer {n}:** {spec}", ""]
    path = scratch(spark, "questionnaire")
    spark.createDataFrame([("\n".join([*text, "# End"]),)], "value string").coalesce(1).write.text(path)
    return readers.read_codebook_prompt(spark, path)


def dated(spark, sf_dir) -> DataFrame:
    """Decisions with an ingestion time and the codebook in force at it."""
    k = F.substring("ID", 2, 20).cast("long")
    rows = parsed(spark, sf_dir).withColumn("k", k).withColumn(
        "ingested", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(CAST(k % 700 AS INT), CAST(k % 24 AS INT))")).drop("k")
    books = codebooks.versions({v: (since, questionnaire(spark, v)) for v, since in BOOK_DATES.items()})
    return codebooks.in_force(rows, books, "ingested")


@query
def s4_codebook_in_force(spark, sf_dir):
    """Tokens of all questions with options, judged by the questionnaire read for the decision's time."""
    return codebooks.validity(dated(spark, sf_dir), OPTION_QUESTIONS)


@query
def x20_decisions(spark, sf_dir):
    return codebooks.core_table(dated(spark, sf_dir), derived.DECISION_FIELDS)


@query
def x20_defendants(spark, sf_dir):
    return codebooks.core_table(dated(spark, sf_dir), derived.DEFENDANT_FIELDS)


def kept_profiles(spark, sf_dir) -> DataFrame:
    """Profiles of all output tables; the wide and long tables come in four loads each."""
    tables = published(spark, sf_dir)
    path = scratch(spark, "profiles")
    for name in ("wide", "long", "validation", "consistency", "qa"):
        df = getattr(tables, name)
        loads = 4 if name in ("wide", "long") else 1
        for i in range(loads):
            part = df.filter(F.pmod(F.xxhash64("decision_id"), F.lit(loads)) == i) if loads > 1 else df
            profiles.load_profile(part, name, str(i)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query
def x21_column_profile(spark, sf_dir):
    """All columns of all output tables; estimates are left out of the comparison."""
    found = profiles.dictionary(profiles.merged(kept_profiles(spark, sf_dir)))
    plain = ~F.col("data_type").isin("double", "float")
    nested = F.col("data_type").rlike("^(array|map)")
    return found.select(
        "table_name", "column_name", "total_rows", "filled_rows",
        *[F.when(plain & ~nested, F.col(c)).alias(c) for c in ("min_text", "max_text")],
        *[F.round(c, 3).alias(c) for c in ("min_number", "max_number")],
    )


@query
def x22_harmonized_tokens(spark, sf_dir):
    """All questions with options; every second token in lower case with hyphens."""
    rows = tokens.question_tokens(parsed(spark, sf_dir), OPTION_QUESTIONS)
    mixed = rows.withColumn("token", F.when(F.col("position") % 2 == 1, F.lower(F.replace("token", F.lit("_"), F.lit("-")))).otherwise(F.col("token")))
    checked = tokens.harmonized_tokens(token_counts(mixed, "question", "token"), BOOK.to_frame(spark))
    return checked.select("question", "raw_token", "token", "validation_error", "n")


@query
def x23_quality(spark, sf_dir):
    rows = dated(spark, sf_dir)
    flags = derived.all_flags(rows, keep=("codebook_version",))
    scored = derived.with_provenance(derived.quality_score(flags), "orders", F.col("codebook_version"), "1")
    return scored.select("decision_id", "quality_score", "source_id", "parser_version", "codebook_version", "mapping_version")


@query
def x23_review_sample(spark, sf_dir):
    """Two hundred decisions for manual review, in proportion to country group and breach."""
    c = ty.clean_country(answers("Q1"))
    rows = parsed(spark, sf_dir).select(F.col("ID").alias("decision_id"), c.alias("c"), F.coalesce(answers("Q16"), F.lit("NONE")).alias("breach"))
    strata = rows.select("decision_id", *ty.country_columns(F.col("c")), "breach").select(
        "decision_id", F.concat_ws("/", "country_group", "breach").alias("stratum"))
    return sampling.stratified_sample(strata, "stratum", "decision_id", 200)


TOLERATED = ("exclusivity_conflict", "decision_date_parse_error", "cross_border_claim_requires_geo_verification",
             "appeal_outcome_present_but_q4_no", "fine_amount_parse_error")


@query
def x23_strict_mode(spark, sf_dir):
    return derived.strict(derived.all_flags(parsed(spark, sf_dir)), TOLERATED).select("decision_id")


@query
def x24_validation_summary(spark, sf_dir):
    return derived.validation_summary(derived.all_flags(parsed(spark, sf_dir)))


# --- document corpus ---------------------------------------------------------
def markdown(spark, sf_dir) -> DataFrame:
    """Each document as a Markdown decision: header fields, contents, sections."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    k = "doc_id"
    return docs.select("doc_id", F.expr(
        f"CASE WHEN {k} % 14 = 3 THEN '# Welcome to the wiki\n\n' || text ELSE"
        f" '# Case ' || CAST({k} AS STRING) || '\n\n## Case Information\n\n**Authority:** ' || source ||"
        f" '\n\n**Jurisdiction:** ' || lang ||"
        f" '\n\n**Relevant Law:** Article ' || CAST({k} % 99 + 1 AS STRING) || '(1)(f) GDPRArticle 32 GDPRArticle ' || CAST({k} % 7 + 1 AS STRING) || '(2)'"
        f" || '\n\n**Decided:** ' || {DECIDED_TEXT} || '\n\n**Fine:** ' || {FINE_TEXT} ||"
        f" '\n\n**Appeal:** \n\n## Contents\n\n* [Facts](#Facts)\n**Authority:** not a header\n\n## English Summary\n\n### Facts\n\n' || text ||"
        f" CASE WHEN {k} % 5 <> 0 THEN '\n\n### Holding\n\nHeld: ' || lang ELSE '' END ||"
        f" '\n\n## Comment\n\nComment on ' || source || '\n\n## English Machine Translation of the Decision\n\n' || text || '\n\n## Annex\n' || lang END"
    ).alias("text"))


DECIDED_TEXT = (
    "CASE doc_id % 6 WHEN 0 THEN '07.10.2022' WHEN 1 THEN '15.3.2021' WHEN 2 THEN '20.07.23' WHEN 3 THEN '20/12/2022'"
    " WHEN 4 THEN '5. 2. 2020' ELSE 'n/a' END"
)
FINE_TEXT = (
    "CASE doc_id % 5 WHEN 0 THEN '3,000 EUR' WHEN 1 THEN '900.000 EUR' WHEN 2 THEN '14,931 RON' WHEN 3 THEN 'n/a'"
    " ELSE CAST(doc_id AS STRING) || ' EUR' END"
)


@query
def d1_d5_header(spark, sf_dir):
    rows = corpus.corpus_columns(corpus.header_fields(corpus.drop_non_decisions(markdown(spark, sf_dir))))
    h = F.col("header")
    return rows.select(
        "doc_id", h["Authority"].alias("authority"), h["Jurisdiction"].alias("jurisdiction"), h["Appeal"].alias("appeal"),
        F.size(F.map_keys(h)).alias("n_fields"), F.col("decided").cast("string").alias("decided"),
        F.col("fine_amount").cast("double").alias("fine_amount"), "fine_currency",
    )


@query
def d2_sections(spark, sf_dir):
    rows = corpus.sections(corpus.drop_non_decisions(markdown(spark, sf_dir)))
    return rows.select("doc_id", F.md5("facts").alias("facts"), "holding", "comment", F.md5("machine_translation").alias("machine_translation"))


@query
def d3_decisions_once(spark, sf_dir):
    """Documents with a header, but for some without one or with it after the contents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.expr(
        "CASE doc_id % 14 WHEN 3 THEN text WHEN 4 THEN '## Contents\n## Contents\n**Jurisdiction:** x' || text"
        " ELSE '**Jurisdiction:** ' || lang || '\n\n## Contents\n\n' || text END"
    ).alias("text")))
    return corpus.drop_exact_duplicates(corpus.drop_non_decisions(docs), "doc_id").select("doc_id", F.length("text").alias("n_chars"))


@query
def d4_cited_articles(spark, sf_dir):
    return corpus.cited_articles(corpus.header_fields(corpus.drop_non_decisions(markdown(spark, sf_dir))), "doc_id")


def write_files(rows: DataFrame, root: str) -> None:
    """One file per row ``(path, text)`` below ``root``; a task that runs again writes the same file."""
    def write(batches):
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["text"]):
                system, place = file_system(f"{root}/{path}")
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(place) as f:
                    f.write(text.encode())
            yield pdf[["path"]]

    rows.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


@query
def s6_corpus_files(spark, sf_dir):
    """Every page as a Markdown file ``<type>/<country>/<id>.md``, scanned as a corpus."""
    root = scratch(spark, "corpus")
    body = F.when(F.col("page_id") % 2 == 0, "authorities").otherwise("courts")
    pages = spread(table(spark, sf_dir, "pages")).select(
        F.concat(body, F.lit("/Land "), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("# "), F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit(""))).alias("text"),
    )
    write_files(pages, root)
    return readers.read_corpus(spark, root).select(
        "doc_id", "body_type", "country", "file_name", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))
