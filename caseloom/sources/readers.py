"""Scans.  Every reader returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import strip
from caseloom.sources import blocks, quoted_csv

MASTER_COLUMNS = ["ID", "response"]


def read_master_csv(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """``(ID, response)`` from CSV with line breaks and doubled quotes in cells.

    A file is read in byte ranges of ``range_bytes``, one task each (see
    :mod:`caseloom.sources.quoted_csv`); a missing response is empty.
    """
    raw = quoted_csv.read(spark, path, MASTER_COLUMNS, range_bytes)
    return raw.withColumn("response", F.coalesce("response", F.lit("")))


def land(df: DataFrame, path: str) -> DataFrame:
    """Write as Parquet and read back: cuts the lineage at durable files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_answer_blocks(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """``(source, range_start, position, value)``: one row per answer block of concatenated files.

    A file is read in byte ranges of ``range_bytes``, short ones several a task.  ``value``
    runs up to the next block; :func:`caseloom.operators.parse.segment_blocks`
    cuts it where a block begins that is not kept.
    """
    blocks.register(spark)
    reader = spark.read.format(blocks.FORMAT)
    return (reader.option("rangeBytes", range_bytes) if range_bytes else reader).load(path)


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """``(question, kind, options)`` from codebook JSON (``questions`` keyed by number)."""
    schema = "questions map<string,struct<kind:string,options:array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.explode("questions").alias("n", "s")).select(
        F.concat(F.lit("Q"), "n").alias("question"), "s.kind", "s.options"
    )


def read_codebook_prompt(spark: SparkSession, path: str) -> DataFrame:
    """``(question, kind, options, spec)`` from a questionnaire in Markdown.

    An answer line reads ``**Answer N:** KIND:...``; when the line itself
    declares no kind the following non-blank line may.  Without either the
    question is RAW.  The last line of the file is only ever looked ahead to.
    """
    text = spark.read.text(path, wholetext=True)
    lines = F.filter(F.transform(F.split("value", r"\r\n|\r|\n"), strip), lambda x: x != "")
    pairs = text.select(lines.alias("l")).select(
        F.posexplode(F.arrays_zip(
            F.slice("l", 1, F.size("l") - 1).alias("line"), F.slice("l", 2, F.size("l")).alias("following")
        )).alias("pos", "p")
    ).select("pos", "p.*")
    shape = r"^\*\*Answer\s+(\d+):\*\*\s*(.+)$"
    kinds = r"^(ENUM|MULTI_SELECT|TYPE|FORMAT):"
    own = F.regexp_extract("line", shape, 2)
    spec = F.when(own.rlike(kinds), own).when(F.col("following").rlike(kinds), F.col("following"))
    rows = pairs.filter(F.col("line").rlike(shape)).select(
        "pos", F.concat(F.lit("Q"), F.regexp_extract("line", shape, 1)).alias("question"),
        F.coalesce(spec, own).alias("spec"), spec.isNotNull().alias("typed"),
    )
    kind = F.when(F.col("typed"), F.substring_index("spec", ":", 1)).otherwise("RAW")
    value = F.when(F.col("typed"), strip(F.regexp_replace("spec", kinds, ""))).otherwise(F.col("spec"))
    options = F.filter(F.transform(F.split(value, ","), strip), lambda t: t != "")
    return rows.select("question", "pos", kind.alias("kind"), value.alias("spec"), options.alias("options")).groupBy(
        "question"
    ).agg(F.max_by(F.struct("kind", "options", "spec"), "pos").alias("s")).select(
        "question", "s.kind",
        F.when(F.col("s.kind").isin("ENUM", "MULTI_SELECT"), F.col("s.options")).alias("options"), "s.spec",
    )


def read_sector_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal, code, description)`` in file order, header and short rows skipped.

    Feed it to :func:`caseloom.operators.enrich.sector_dimension`.  ``multiLine``
    keeps one file in one task, so the generated id follows the file.
    """
    rows = (
        spark.read.schema("code string, description string, _bad string")
        .option("header", True).option("multiLine", True).option("escape", '"')
        .option("columnNameOfCorruptRecord", "_bad").csv(path)
    )
    short = F.col("description").isNull() & F.col("_bad").isNotNull()
    return rows.withColumn("ordinal", F.monotonically_increasing_id()).filter(~short).select(
        "ordinal", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("description", F.lit("")).alias("description")
    )


def read_corpus(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Markdown decisions below ``path/<body type>/<country>/``.

    ``doc_id`` hashes the path below the corpus, so it is stable across runs.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    parts = F.split(plain, "/")
    rows = files.select(F.col("value").alias("text"), F.slice(parts, -3, 3).alias("p"))
    return rows.select(
        F.sha2(F.array_join("p", "/"), 256).alias("doc_id"), F.col("p")[0].alias("body_type"),
        F.col("p")[1].alias("country"), F.col("p")[2].alias("file_name"), "text",
    )


def read_qa_summary(spark: SparkSession, path: str) -> DataFrame:
    """The QA summary CSV with its JSON columns as a map and an array again."""
    schema = ("field_prefix string, total_rows long, rows_with_known long, rows_with_unknown long, total_unknown_tokens long,"
              " status_counts_json string, top_unknown_tokens_json string")
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    top = F.from_json("top_unknown_tokens_json", "array<array<string>>")
    return rows.select(
        "field_prefix", "total_rows", "rows_with_known", "rows_with_unknown", "total_unknown_tokens",
        F.from_json("status_counts_json", "map<string,bigint>").alias("status_counts"),
        F.transform(top, lambda e: F.struct(e[0].alias("token"), e[1].cast("long").alias("n"))).alias("top_unknown_tokens"),
    )
