"""Quality rules: clean line by line first, then judge the document by what was lost.

Built from DataFrame functions only; every rule is a column over the lines of
one row, so there is no shuffle and a document never leaves its row.

Defined cases: a null text counts as empty; an empty text has no words, loses
nothing and fails the base rule for short documents; repeated rows are judged
one by one; other columns are left out of the result, so their names can't
clash; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import WHITE_CLASS, table, words

# The symbols that the base counts.
SYMBOLS = "#*$%&|<>"
#: Marks that may end a line of prose.
TERMINAL = ".!?…:;\"'”»)]"
#: Full stops of other scripts, which ``Rules.by_share`` adds.
OTHER_TERMINAL = "。．！？｡।॥؟۔።။។"
#: Marks that prose uses sparingly.
NOISE = SYMBOLS + "{}[]~^=+!?"
#: Phrases of legal, cookie and script notices, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "use of cookies", "enable javascript", "lorem ipsum", "click here to", "subscribe to our newsletter",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; lengths in characters."""

    window: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20
    max_noise_percent: int = 8
    min_noise: int = 4
    max_separators: int = 1
    short_line: int = 24
    max_lost_percent: int = 50
    #: Hold separators and phrases against the line's length; ``op7``, whose SQL counts them alone, does not.
    by_share: bool = False
    separator_words: int = 6
    notice_length: int = 160
    notice_percent: int = 10


def has_word(line: Column) -> Column:
    return F.rlike(line, F.lit(f"[^{WHITE_CLASS}]"))


def count_of(text: Column, characters: str) -> Column:
    """Java's regular expressions count characters faster than ``translate``."""
    listed = "".join("\\" + c for c in characters)
    return F.length(text) - F.length(F.regexp_replace(text, f"[{listed}]", ""))


def fails_punctuation(line: Column, rules: Rules) -> Column:
    """Mostly symbols or exclamation, or a short line that no mark ends."""
    bound = F.greatest(F.lit((rules.min_noise - 1) * 100), F.length(line) * rules.max_noise_percent)
    bare = (F.length(line) < rules.short_line) & ~F.substring(F.rtrim(line), -1, 1).isin(*TERMINAL, *(OTHER_TERMINAL if rules.by_share else ()))
    return bare | (count_of(line, NOISE) * 100 > bound)


def fails_navigation(line: Column, rules: Rules) -> Column:
    """Several menu separators; by share, at most ``separator_words`` words to each, and none in paired quotation marks."""
    if rules.by_share:
        bare = F.regexp_replace(line, "«([^«»]*)»|»([^«»]*)«|›([^‹›]*)‹|‹([^‹›]*)›", " ")
        n = count_of(bare, "|»›·")
        return (n > rules.max_separators) & (F.size(words(line)) <= n * rules.separator_words)
    return F.rlike(line, F.lit("(?:[|»›·][^|»›·]*){%d}" % (rules.max_separators + 1)))


def any_phrase(lowered: Column) -> Column:
    """Whether lower-case text holds a boilerplate phrase."""
    found = [F.contains(lowered, F.lit(phrase)) for phrase in BOILERPLATE]
    out = found[0]
    for one in found[1:]:
        out = out | one
    return out


def fails_notice(line: Column, rules: Rules) -> Column:
    """A boilerplate phrase; by share, in a short line or over a set share of the line."""
    lowered = F.lower(line)
    if not rules.by_share:
        return any_phrase(lowered)
    covered = F.lit(0)
    for phrase in BOILERPLATE:
        covered = covered + F.length(lowered) - F.length(F.replace(lowered, F.lit(phrase), F.lit("")))
    much = (F.length(line) <= rules.notice_length) | (covered * 100 >= F.length(line) * rules.notice_percent)
    return any_phrase(lowered) & much


def repeat_words(w: Column, rules: Rules) -> tuple[Column, Column]:
    """(keys of the word windows, positions of exactly repeated windows), see ``measure``."""
    n = rules.window
    places = F.sequence(F.lit(0), F.size(w) - n)
    keys = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    exact = F.sort_array(
        F.transform(places, lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]).alias("k"), i.alias("p")))
    )
    return F.when(F.size(w) > n, keys), exact


def measure(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Base counts, cleaned text and verdict per document.

    Windows of words are compared by hash first.  Only a document with two equal
    hashes builds the windows as strings; there equal neighbours of the sorted
    windows are repeats, so a hash collision can't count.
    """
    n = rules.window
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    df = df.select(
        "doc_id", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), has_word).alias("lines"),
        any_phrase(F.lower("text")).alias("notice"),
    )
    keys, exact = repeat_words(F.col("w"), rules)
    passes = F.filter(
        "lines",
        lambda x: ~(fails_punctuation(x, rules) | fails_navigation(x, rules) | (F.col("notice") & fails_notice(x, rules))),
    )
    df = df.select(
        "doc_id", "text", "w", F.size("w").cast("long").alias("n_words"), keys.alias("keys"),
        F.size("lines").alias("n_lines"), F.array_distinct("lines").alias("once"), F.array_distinct(passes).alias("good"),
        F.length(F.array_join("lines", "")).alias("all_chars"),
    )
    df = df.select(
        "doc_id", "text", "w", "n_words", "n_lines", "once", "good", "all_chars",
        F.coalesce(F.size(F.array_distinct("keys")) < F.size("keys"), F.lit(False)).alias("suspect"),
    )
    df = df.select(
        "doc_id", "text", "n_words", "n_lines", "once", "good", "all_chars",
        F.when(F.col("suspect"), exact).alias("sorted"),
    )
    same = lambda x, i: (x["k"] == F.get("sorted", i - 1)["k"]) | (x["k"] == F.get("sorted", i + 1)["k"])
    df = df.withColumn("places", F.sort_array(F.transform(F.filter("sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"])))
    gaps = F.transform("places", lambda p, i: F.least(F.lit(n), F.coalesce(F.get("places", i + 1) - p, F.lit(n))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    df = df.select(
        "doc_id", "text", "n_words", F.length(F.regexp_replace("text", f"[{WHITE_CLASS}]+", "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.col("n_lines") - F.size("once")).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        "n_lines", F.size("good").alias("n_good_lines"), "all_chars", F.array_join("good", "\n").alias("good_text"),
        (F.length(F.array_join("good", ""))).alias("good_chars"),
    )
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    lost = (F.col("all_chars") - F.col("good_chars")) * 100 > F.col("all_chars") * rules.max_lost_percent
    cleaned = F.when(F.col("n_good_lines") == F.col("n_lines"), F.col("text")).otherwise(F.col("good_text"))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~lost).alias("kept"), (F.col("n_lines") - F.col("n_good_lines")).cast("long").alias("n_removed_lines"),
        cleaned.alias("cleaned"),
    )


def keep_documents(documents: DataFrame, rules: Rules = Rules(by_share=True)) -> DataFrame:
    """The documents that pass, all columns, with the failing lines taken out of ``text``.

    The verdict is computed on the row itself: a struct carries the row through
    ``measure``, so nothing is joined and repeated or null ids are harmless.
    """
    packed = documents.select(F.struct("*").alias("doc_id"), F.col("text"))
    # the row number keeps the optimizer from pushing the verdict below, which would repeat all its rules
    judged = measure(packed, rules=rules).withColumn("fence", F.monotonically_increasing_id()).filter("kept and fence >= 0")
    out = judged.select("doc_id.*", "cleaned", "n_removed_lines")
    text = F.when(F.col("n_removed_lines") > 0, F.col("cleaned")).otherwise(F.col("text"))
    return out.select(*[
        text.alias("text") if c == "text"
        else F.when(F.col("n_removed_lines") > 0, F.length("cleaned").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars"
        else F.col(f"`{c}`") for c in documents.columns
    ])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents")).drop("cleaned")


def sql() -> str:
    """The same in DuckDB's SQL."""
    phrases = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
    quoted = ", ".join("'" + c.replace("'", "''") + "'" for c in TERMINAL)
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    noise = f"(length(x) - length(translate(x, '{NOISE}', '')))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(string_split(translate(t, {white}, '      '), ' '), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: translate(x, {white}, '') <> '') AS lines
  FROM d),
p AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5)),
r AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM p), range(5) AS s(o)
  WHERE c > 1 GROUP BY rid),
g AS (
  SELECT *, list_distinct(list_filter(lines, lambda x: NOT (
      ({noise} >= 4 AND {noise} * 100 > length(x) * 8)
      OR (length(x) < 24 AND NOT (right(rtrim(x, ' '), 1) IN ({quoted})))
      OR length(x) - length(translate(x, '|»›·', '')) > 1
      OR {phrases}))) AS good
  FROM w),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {white}, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) - len(good) AS BIGINT) AS n_removed_lines,
    coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS all_chars,
    coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS good_chars
  FROM g LEFT JOIN r ON g.rid = r.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines,
  (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AS base_failed,
  NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AND NOT ((all_chars - good_chars) * 100 > all_chars * 50) AS kept
FROM m
"""
