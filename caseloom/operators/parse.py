"""Segmentation and parsing of answer blocks.  All narrow: no shuffle."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import strip
from caseloom.vocab import EXPECTED_QUESTIONS, PARSER_VERSION, SPACE_CHARS, SPACE_CLASS, ZERO_WIDTH_SPACE

# An empty answer runs into the next line, which becomes its value.
_ANSWER = rf'(?m)^"?Answer{SPACE_CLASS}+(\d+):{SPACE_CLASS}*([^\n]+)'
# (?d): only \n ends a line
_BLOCK_START = rf'(?md)(?=^"?Answer{SPACE_CLASS}+1:)'
_LINE_BREAKS = ("\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")

#: Text that is cut at once, in bytes.
_SLICE_BYTES = 1 << 23

_EXPECTED_KEYS = [f"Q{i}" for i in range(1, EXPECTED_QUESTIONS + 1)]


def block_array(text: Column) -> Column:
    """The blocks of a text, in order, as an array."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), _BLOCK_START), strip)
    return F.filter(
        pieces,
        lambda p: F.startswith(p, F.lit("Answer 1:")) | F.startswith(p, F.lit('"Answer 1:')),
    )


def segment_blocks(df: DataFrame, text_col: str = "value") -> DataFrame:
    """One row per answer block; ``record_index`` counts the kept blocks of a text."""
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.posexplode(block_array(F.col(text_col))).alias("record_index", "response"))


def _read_udf():
    """Text to ``struct<answers, lines>``: the last of repeated answers counts, at its own place.

    Most texts are plain: each line that begins with the word is ``Answer n:`` with a value behind it, and no n is
    repeated.  Such lines are cut by Arrow kernels, all texts of a batch at once; any other text (an empty answer takes
    the next line, a quote, other white space or digits, repeated answers) goes through the pattern.
    """
    # local functions travel by value: executors need not import this package
    pattern, spaces, zero_width = re.compile(_ANSWER), SPACE_CHARS, ZERO_WIDTH_SPACE
    most_bytes = _SLICE_BYTES
    maybe = np.zeros(256, dtype=bool)
    maybe[[mark.encode()[-1] for mark in _LINE_BREAKS]] = True

    def by_pattern(text):
        found = {}
        for n, value in pattern.findall(text):
            found.pop(f"Q{n}", None)
            found[f"Q{n}"] = value.strip(spaces).strip(zero_width)
        return found

    def line_counts(texts):
        # by the bytes: \n, \x0b, \x0c, \r and \x1c to \x1e, or the last byte of \x85, \u2028 and \u2029
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        ends = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        if not len(texts) or ends[0] == ends[-1]:
            return np.zeros(len(texts), dtype=np.int32)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        at = np.flatnonzero(maybe[data])
        byte, before, second = data[at], data[at - 1], data[at - 2]  # a last byte has others before it
        at = at[(byte < 0x80) | ((byte == 0x85) & (before == 0xC2)) | ((byte > 0x85) & (before == 0x80) & (second == 0xE2))]
        row = np.searchsorted(ends, at, side="right") - 1
        closed = np.zeros(len(texts), dtype=bool)
        closed[row[at == ends[row + 1] - 1]] = True
        pair = (data[at] == 0x0A) & (data[at - 1] == 0x0D) & (at > ends[row])
        counts = np.bincount(row[~pair], minlength=len(texts))
        return np.where(ends[1:] == ends[:-1], 0, counts + ~closed).astype(np.int32)

    def read(texts):
        split = pc.split_pattern(texts, "\n")
        lines, row = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
        asked = pc.or_(pc.starts_with(lines, "Answer"), pc.starts_with(lines, '"Answer'))
        lines, row = lines.filter(asked), row[asked.to_numpy(zero_copy_only=False)]
        odd = np.zeros(len(texts), dtype=bool)

        # a line that is cut has the word, a space, a number of at least one digit and a colon
        plain = pc.and_(pc.starts_with(lines, "Answer "), pc.greater(pc.find_substring(lines, ":"), 7)).to_numpy(zero_copy_only=False)
        odd[row[~plain]] = True
        lines, row = lines.filter(pa.array(plain)), row[plain]
        halves = pc.list_flatten(pc.split_pattern(lines, ":", max_splits=1))
        numbers = pc.utf8_slice_codeunits(halves.take(pa.array(np.arange(0, len(halves), 2))), 7)
        values = pc.utf8_trim(halves.take(pa.array(np.arange(1, len(halves), 2))), characters=spaces)
        good = pc.and_(pc.and_(pc.string_is_ascii(numbers), pc.ascii_is_decimal(numbers)), pc.not_equal(values, ""))
        odd[row[~good.to_numpy(zero_copy_only=False)]] = True
        named = numbers.dictionary_encode()
        codes = row.astype(np.int64) * (len(named.dictionary) + 1) + named.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        odd[row[order[1:][codes[order[1:]] == codes[order[:-1]]]]] = True

        keep = ~odd[row]
        keys = pc.binary_join_element_wise(pa.scalar("Q", numbers.type), numbers, pa.scalar("", numbers.type)).filter(pa.array(keep))
        values, row = pc.utf8_trim(values, characters=zero_width).filter(pa.array(keep)), row[keep]
        if odd.any():
            others = np.flatnonzero(odd)
            found = [by_pattern(t) for t in texts.take(pa.array(others)).to_pylist()]
            keys = pa.concat_arrays([keys, pa.array([k for f in found for k in f], keys.type)])
            values = pa.concat_arrays([values, pa.array([v for f in found for v in f.values()], values.type)])
            row = np.concatenate([row, np.repeat(others, [len(f) for f in found])])
            place = pa.array(np.argsort(row, kind="stable"))
            keys, values = keys.take(place), values.take(place)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
        answers = pa.MapArray.from_arrays(pa.array(ends), keys.cast(pa.string()), values.cast(pa.string()))
        return pa.StructArray.from_arrays([answers, pa.array(line_counts(texts))], ["answers", "lines"])

    def read_all(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        # temporary arrays of a few times the text: slices of bounded size, a longer text alone
        at = pc.cumulative_sum(pc.cast(pc.binary_length(texts), pa.int64())).to_numpy() // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
        return pa.concat_arrays([read(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])

    return F.arrow_udf(read_all, "struct<answers: map<string, string>, lines: int>")


def with_answers(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Adds ``answers`` (``map<Qn, value>``, the last of repeated answers counts),
    ``questions``, the distinct keys, and ``lines``, their number as ``str.splitlines`` counts them.

    Staged selects, so that each expression runs once per row.
    """
    read = df.withColumn("_read", _read_udf()(F.col(response_col)))
    found = read.withColumns({"answers": F.col("_read.answers"), "lines": F.col("_read.lines")}).drop("_read")
    return found.withColumn("questions", F.map_keys("answers"))


def parse_metadata(lines: Column, questions: Column, missing: Column) -> Column:
    """``lines`` counts the lines of the text; ``missing`` lists the expected questions that are absent (empty when complete)."""
    count = F.size(questions)
    complete = count == EXPECTED_QUESTIONS
    warning = F.concat(
        F.lit("incomplete_record: missing="),
        F.array_join(F.slice(missing, 1, 10), ","),
        F.when(F.size(missing) > 10, "...").otherwise(""),
    )
    return F.struct(
        lines.alias("line_count"),
        complete.alias("completeness"),
        count.alias("question_count"),
        missing.alias("missing_questions"),
        F.when(complete, F.array().cast("array<string>")).otherwise(F.array(warning)).alias("warnings"),
        F.lit(PARSER_VERSION).alias("parser_version"),
    )


def parse_records(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Adds ``answers`` and ``metadata``; the text itself is dropped.

    For a result that is written at once.  Use :func:`parse_answers` when more
    operators follow in the same plan.
    """
    others = [c for c in df.columns if c != response_col]
    text = F.coalesce(F.col(response_col), F.lit(""))
    parsed = with_answers(df.select(*others, text.alias(response_col)), response_col)
    questions = F.col("questions")
    missing = F.when(F.size(questions) == EXPECTED_QUESTIONS, F.array().cast("array<string>")).otherwise(
        F.array_except(F.lit(_EXPECTED_KEYS), questions)
    )
    meta = parse_metadata(F.col("lines"), questions, F.col("_missing"))
    return parsed.withColumn("_missing", missing).select(*others, "answers", meta.alias("metadata"))


def parse_answers(df: DataFrame, response_col: str = "response") -> DataFrame:
    """:func:`parse_records` for use inside a longer plan.

    The record leaves through a one-element explode.  Filters on answers stop
    there: pushed further down, each would repeat the parsing expressions.
    """
    records = parse_records(df, response_col)
    others = [c for c in records.columns if c not in ("answers", "metadata")]
    packed = F.array(F.struct("answers", "metadata"))
    return records.select(*others, F.explode(packed).alias("_record")).select(*others, "_record.answers", "_record.metadata")


def parse_blocks(df: DataFrame, text_col: str = "value") -> DataFrame:
    """Concatenated text to parsed records with an ingestion time."""
    blocks = segment_blocks(df, text_col).withColumn("ingestion_timestamp", F.current_timestamp())
    return parse_answers(blocks)
