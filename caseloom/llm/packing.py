"""Packing token ids into windows by minimum bin slack.

A document is cut at every full window; what remains is shorter than a window.
Lengths are whole numbers below the window, so the global histogram of remaining
lengths (at most ``window`` counts, whatever the input) describes the whole
packing problem.  The driver plans on it: beginning with the longest length, a
bitset subset-sum over the remaining multiset finds the filling closest to the
capacity, backtracking gives the counts, and the pattern is used as often as the
counts allow.  Where the best filling leaves more than ``max_slack``, one more
piece is cut to fill it.  The plan becomes interval rules over (length, rank);
each piece finds its place by its rank among pieces of its length.

Defined cases: a null or empty text is its end id alone; repeated rows and null
ids are packed like any other row; other columns are left out of the result; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import land, table
from caseloom.llm.tokens import REMEMBERED, encode_slices, vocabulary_path

WINDOW = 1024
#: Tokens of a window that may stay empty while other pieces are left.
MAX_SLACK = 16
#: Rows of one length are ranked in at least so many slices of at most so many rows.
SLICES, SLICE_ROWS = 64, 100_000


def closest_filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``capacity``: bitset subset-sum, backtracked."""
    reach, steps, full = 1, [], (1 << (capacity + 1)) - 1
    for length in sorted((n for n in counts if n <= capacity and counts[n] > 0), reverse=True):
        left, bundle = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(bundle, left)
            steps.append((reach, length, take))
            reach |= (reach << (take * length)) & full
            left -= take
            bundle *= 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_rules(histogram: dict[int, int], window: int = WINDOW, max_slack: int = MAX_SLACK) -> list[tuple]:
    """Rules (length, lo, hi, cut, size, t0, k, seq_base, at).

    A piece of ``length`` whose rank lies in [lo, hi) gives its ``size`` ids from
    ``cut`` on as item t = t0 + rank - lo of its pattern: sequence
    seq_base + t // k, at offset at + (t % k) * size.
    """
    queues: dict[int, deque] = {n: deque([(n, 0, 0, c)]) for n, c in histogram.items() if 0 < n <= window and c > 0}
    counts = {n: c for n, c in histogram.items() if n in queues}
    rules, seq = [], 0

    def use(size: int, times: int, k: int, at: int, take: int | None = None) -> list[tuple]:
        """Take times * k pieces of ``size``; of each only ``take`` ids if given. Returns what was taken."""
        left, t0, taken = times * k, 0, []
        counts[size] -= left
        while left:
            length, cut, lo, hi = queues[size].popleft()
            n = min(left, hi - lo)
            if lo + n < hi:
                queues[size].appendleft((length, cut, lo + n, hi))
            rules.append((length, lo, lo + n, cut, take or size, t0, k, seq, at))
            taken.append((length, cut, lo, lo + n))
            t0, left = t0 + n, left - n
        return taken

    while sizes := [n for n, c in counts.items() if c > 0]:
        first = max(sizes)
        others = dict(counts)
        others[first] -= 1
        chosen = closest_filling(others, window - first)
        chosen[first] = chosen.get(first, 0) + 1
        slack = window - sum(n * k for n, k in chosen.items())
        times = min(counts[n] // k for n, k in chosen.items())
        more = None
        if slack > max_slack:
            left = {n: counts[n] - times * chosen.get(n, 0) for n in sizes}
            fits = [n for n in sizes if n > slack and left[n] > 0]
            if not fits and times > 1:  # of the pieces used here, some are cut for the others
                fits = [n for n in chosen if n > slack and counts[n] // (chosen[n] + 1) > 0]
                if fits:
                    more = min(fits)
                    times = min(min(counts[n] // k for n, k in chosen.items() if n != more) if len(chosen) > 1 else times, counts[more] // (chosen[more] + 1))
            elif fits:
                more = min(fits)
                times = min(times, left[more])
        at = 0
        for n in sorted(chosen, reverse=True):
            use(n, times, chosen[n], at)
            at += n * chosen[n]
        if more:
            for length, cut, lo, hi in use(more, times, 1, at, slack):
                queues.setdefault(more - slack, deque()).append((length, cut + slack, lo, hi))
                counts[more - slack] = counts.get(more - slack, 0) + hi - lo
        seq += times
    return rules


def token_rows(documents: DataFrame, id_col: str, text_col: str, end_id: int, window: int, path: str | None, remembered: int) -> DataFrame:
    """(row, doc_id, n, crcs of the full windows, tail ids), landed."""
    kind = T.StructType([
        T.StructField("n", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("tail", T.BinaryType()),
    ])

    @F.pandas_udf(kind)
    def encode(texts: pd.Series) -> pd.DataFrame:
        end, out = np.array([end_id], "<u4").tobytes(), []
        for ids in encode_slices(texts, path, remembered):
            ids += end
            full = len(ids) // (4 * window) * 4 * window
            out.append((len(ids) // 4, [zlib.crc32(ids[i : i + 4 * window]) for i in range(0, full, 4 * window)], ids[full:]))
        return pd.DataFrame(out, columns=["n", "crcs", "tail"])

    marked = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), encode(F.coalesce(F.col(text_col), F.lit(""))).alias("t")
    )
    return land(marked, "tokens").select("row", "doc_id", "t.n", "t.crcs", "t.tail")


def pack(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, window: int = WINDOW,
    max_slack: int = MAX_SLACK, path: str | None = None, remembered: int = REMEMBERED,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    ``remembered`` words per worker trade memory for speed; the result is the same.
    """
    spark = documents.sparkSession
    rows = token_rows(documents, id_col, text_col, end_id, window, vocabulary_path(path), remembered)
    whole = rows.filter(F.size("crcs") > 0).select(
        "row", "doc_id", "n", F.posexplode("crcs").alias("k", "crc")
    ).select("row", "doc_id", "n", (F.col("k") * window).cast("long").alias("start"), F.lit(window).alias("length"), "crc")
    tails = rows.filter(F.col("n") % window > 0).select(
        "row", "doc_id", "n", (F.col("n") - F.col("n") % window).alias("start"), (F.col("n") % window).cast("int").alias("length"),
        F.crc32("tail").alias("crc"),
    )
    pieces = whole.union(tails)
    total = pieces.count()
    slices = max(SLICES, total // SLICE_ROWS)
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("row", "start"), F.lit(slices)))
    ranked = sliced.withColumn("rn", F.row_number().over(Window.partitionBy("length", "slice").orderBy("row", "start")) - 1)
    sizes = land(sliced.groupBy("length", "slice").count(), "sizes")
    before = sizes.select(
        "length", "slice",
        (F.sum("count").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"),
    )
    placed = ranked.join(before, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("rn"))
    histogram = {r["length"]: r["sum(count)"] for r in sizes.groupBy("length").sum("count").collect()}
    schema = "length int, lo long, hi long, cut long, size long, t0 long, k long, seq_base long, at long"
    rules = F.broadcast(spark.createDataFrame(plan_rules(histogram, window, max_slack), schema))  # bounded by the lengths
    item = F.col("t0") + F.col("rank") - F.col("lo")
    found = placed.join(rules, (placed["length"] == rules["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "row", "doc_id", (F.col("start") + F.col("cut")).alias("start"), placed["length"].alias("whole"), "cut", F.col("size").alias("length"),
        "crc", F.col("n").alias("doc_tokens"), (F.col("seq_base") + F.floor(item / F.col("k"))).alias("sequence_id"),
        (F.col("at") + F.pmod(item, F.col("k")) * F.col("size")).alias("offset"),
    )
    found = land(found, "placed")
    return with_cut_crc(found, rows)


def with_cut_crc(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Checksums of pieces cut by the plan come from the landed ids of their documents."""
    columns = ["doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    plain = found.filter("length = whole").select(*columns)
    cut = found.filter("length < whole")

    @F.pandas_udf(T.LongType())
    def crc_of(tail: pd.Series, at: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(t[4 * a : 4 * (a + k)]) for t, a, k in zip(tail, at, n)], dtype="int64")

    again = cut.drop("crc").join(rows.select("row", "tail"), "row").withColumn("crc", crc_of("tail", "cut", "length"))
    return plain.union(again.select(*columns))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
