"""Benchmark decontamination by the q-gram lemma.

A window of ``m`` characters that occurs with at most ``k`` edits shares at
least ``m + 1 - q * (k + 1)`` of its q-grams with the text, on diagonals (text
position minus window position) that differ by at most ``k``.  Shared q-grams
are counted in bands of ``2 * (k + 1)`` diagonals that overlap by half, so such
an occurrence lies in one band whole.  Bands that reach the bound are verified
by a banded alignment; the others can't hold an occurrence.

Texts and items are compared in lower case, with ASCII punctuation and white
space as single spaces; spans count characters of that form.  An item is
searched whole or, above ``window`` characters, by windows whose starts lie no
more than their edit budget (12) apart; besides it is searched by passages of
half a window (60 characters, starts 6 apart) with half the edit share, as
shorter passages have fewer q-grams to tell.  So a passage of an item is found
wherever it lies in it: from 60 characters on if verbatim, from 65 on with up to
3 edits in 60, from 131 on with up to 12 in 120.  Shorter passages, and parts of
items under 60 characters, are not looked for.  Items too short for their edit
budget at ``q`` are indexed with half of it.

The benchmark is the query set: it is sent to executors in blocks of bounded
size, and every block is held against all documents.

Defined cases: a null or empty text matches nothing; items with null id or with
fewer than ``q`` characters are left out; repeated rows are judged one by one;
other columns are left out of ``find``; empty tables give no matches.
"""

from __future__ import annotations

import string
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import table, total

#: Bytes of benchmark text in one broadcast.
BLOCK_BYTES = 3 << 20
#: Characters of a document that are searched at a time.
STRETCH = 1 << 20

_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_MIX = np.uint64(0x9E3779B97F4A7C15)
MATCH = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("edits", T.IntegerType()),
]))


@dataclass(frozen=True)
class Limits:
    q: int = 8
    edit_percent: int = 10
    window: int = 120


def plain(text: str) -> str:
    return b" ".join(text.lower().encode(errors="replace").translate(_PLAIN).split()).decode()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def grams(code: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each position on."""
    if len(code) < q:
        return np.zeros(0, np.uint64)
    out, have, power = code.astype(np.uint64), 1, _MIX
    parts = [(out, 1, power)]
    while have * 2 <= q:  # hashes of 2, 4, 8, .. characters from those of half as many
        out = out[:-have] * power + out[have:]
        have, power = have * 2, np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
        parts.append((out, have, power))
    mixed, done = None, 0
    for h, size, p in reversed(parts):
        while done + size <= q:
            piece = h[done : done + len(code) - q + 1]
            mixed = piece.copy() if mixed is None else mixed * p + piece
            done += size
    mixed ^= mixed >> np.uint64(29)
    return mixed * _MIX


def windows_of(text: str, size: int, step: int) -> list[str]:
    """Windows of ``size`` characters, ``step`` apart, the last one at the end."""
    if len(text) <= size:
        return [text]
    starts = list(range(0, len(text) - size, step)) + [len(text) - size]
    return [text[s : s + size] for s in starts]


def searched(text: str, limits: Limits) -> list[tuple[str, int]]:
    """The windows of an item, or the whole of it, and its passages, each with its edit share in percent."""
    full, half, least = limits.edit_percent, limits.edit_percent // 2, limits.window // 2
    windows = windows_of(text, limits.window, max(limits.window * full // 100, 1))
    passages = windows_of(text, least, max(2 * (least * half // 100), 1)) if len(text) > least else []
    return [(w, full) for w in windows] + [(p, half) for p in passages]


def banded_distance(pattern: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence whose diagonals lie in [low - k, high + k), if within ``k`` edits."""
    first, width = low - k, high - low + 2 * k
    padded = np.full(len(pattern) + width + 1, -1, np.int64)
    a, b = max(first, 0), min(first + len(padded), len(text))
    if b > a:
        padded[a - first : b - first] = text[a:b]
    at = np.arange(width)
    drop, drop_start = np.full(width, k + 1), np.zeros(width, np.int64)
    cost = np.where((first + at >= 0) & (first + at <= len(text)), 0, k + 1)
    start = first + at
    for i, c in enumerate(pattern):
        swap = cost + (padded[i : i + width] != c)
        np.add(cost[1:], 1, out=drop[:-1])
        drop_start[:-1] = start[1:]
        start = np.where(drop < swap, drop_start, start)
        slope = np.minimum(swap, drop) - at
        best = np.minimum.accumulate(slope)
        start, cost = start[np.maximum.accumulate(np.where(slope == best, at, 0))], best + at
        if i % 8 == 7 and cost.min() > k:
            return None
    d = int(np.argmin(cost))
    return (int(cost[d]), int(start[d]), first + d + len(pattern)) if cost[d] <= k else None


class Index:
    """Q-grams of all windows of a block of items."""

    def __init__(self, items: Iterable[tuple[int, str]], limits: Limits, q: int | None = None):
        self.q, self.item, self.text, self.code, k_of, need = q or limits.q, [], [], [], [], []
        keys, at, short = [], [], []
        for item_id, text in items:
            text = plain(text or "")
            if item_id is None or len(text) < limits.q:
                continue
            if q is None and len(text) * limits.edit_percent // 100 > (len(text) - limits.q) // limits.q:
                short.append((item_id, text))
                continue
            for w, share in searched(text, limits):
                m = len(w)
                k = min(m * share // 100, (m - self.q) // self.q)
                code = codes(w)
                keys.append(grams(code, self.q))
                at.append(np.arange(m - self.q + 1, dtype=np.int64) | len(self.text) << 32)
                self.item.append(item_id)
                self.text.append(w)
                self.code.append(code.astype(np.int64))
                k_of.append(k)
                need.append(m + 1 - self.q * (k + 1))
        #: Items whose edit budget needs shorter q-grams.
        self.short = Index(short, limits, max(limits.q // 2, 1)) if short else None
        self.longest = max(map(len, self.text), default=0)
        self.k, self.need = np.array(k_of, np.int64), np.array(need, np.int64)
        key, self.place = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (at, np.int64)))
        order = np.argsort(key, kind="stable")
        self.place = self.place[order]
        self.key, self.begin = np.unique(key[order], return_index=True)
        self.count = np.diff(np.append(self.begin, len(key)))
        self.shift = np.uint64(64 - max(16, int(np.ceil(np.log2(len(self.key) * 32 + 1)))))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self.key >> self.shift] = True

    def bands(self, code: np.ndarray) -> list[tuple[int, int]]:
        """(window, band) pairs that reach the bound of the q-gram lemma."""
        h = grams(code, self.q)
        pos = np.flatnonzero(self.maybe[h >> self.shift])
        if not len(pos):
            return []
        found = np.searchsorted(self.key, h[pos])
        found[found == len(self.key)] = 0
        same = self.key[found] == h[pos]
        pos, found = pos[same], found[same]
        n = self.count[found]
        which = np.repeat(self.begin[found] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        place = self.place[which]
        w = place >> 32
        enough = np.flatnonzero((np.bincount(w, minlength=len(self.need)) >= self.need)[w])  # others can't reach the bound in a band
        if not len(enough):
            return []
        place, w = place[enough], w[enough]
        diagonal = np.repeat(pos, n)[enough] - (place & 0xFFFFFFFF)
        band = diagonal // (self.k[w] + 1)
        both = np.concatenate([w << 40 | (band + (1 << 30)), w << 40 | (band - 1 + (1 << 30))])
        order = np.argsort(both, kind="stable")
        both, spot = both[order], np.concatenate([place, place])[order] & 0xFFFF
        starts = np.flatnonzero(np.diff(both, prepend=-1))
        counts = np.diff(np.append(starts, len(both)))
        likely = np.flatnonzero(counts >= self.need[both[starts] >> 40])
        # a q-gram of the window counts once, however often the band of the text has it
        keys = [
            both[starts[i]] for i in likely
            if len(set(spot[starts[i] : starts[i] + counts[i]].tolist())) >= self.need[both[starts[i]] >> 40]
        ]
        return [(int(x) >> 40, (int(x) & ((1 << 40) - 1)) - (1 << 30)) for x in keys]

    def matches(self, text: str) -> list[tuple]:
        """The first found occurrence of each item: (item_id, start, end, edits)."""
        clean = plain(text)
        found = {m[0]: m for m in self.short.matches(clean)} if self.short else {}
        overlap = 2 * self.longest
        for at in range(0, max(len(clean), 1), STRETCH):
            part = clean[at : at + STRETCH + overlap]
            code = codes(part)
            wide = None
            for w, band in self.bands(code) if len(self.key) else []:
                item, k, m = self.item[w], int(self.k[w]), len(self.text[w])
                if item in found:
                    continue
                low, high = band * (k + 1), (band + 2) * (k + 1)
                s = part.find(self.text[w], max(low - k, 0), max(high + k + m, 0))
                if s >= 0:
                    found[item] = (item, at + s, at + s + m, 0)
                    continue
                wide = code.astype(np.int64) if wide is None else wide
                got = banded_distance(self.code[w], wide, low, high, k)
                if got:
                    found[item] = (item, at + got[1], at + got[2], got[0])
        return [found[i] for i in sorted(found)]


_INDEXES: dict[tuple[str, int], Index] = {}


def matcher(documents: DataFrame, benchmark: DataFrame, limits: Limits = Limits()):
    """A function from a text column to the matches; the benchmark is collected block by block."""
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    blocks = total(items, F.sum(F.octet_length("text"))) // BLOCK_BYTES + 1
    udfs = []
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in mine.collect()])
        key = (spark.sparkContext.applicationId, sent._jbroadcast.id())

        def index(sent=sent, key=key) -> Index:
            if key not in _INDEXES:
                _INDEXES.clear()
                _INDEXES[key] = Index(sent.value, limits)
            return _INDEXES[key]

        udfs.append(_block_udf(index))
    return lambda text: F.flatten(F.array(*[u(F.coalesce(text, F.lit(""))) for u in udfs]))


def _block_udf(index):
    @F.pandas_udf(MATCH)
    def find(texts: pd.Series) -> pd.Series:
        held = index()
        return pd.Series([[dict(zip(("item_id", "start", "end", "edits"), m)) for m in held.matches(t)] for t in texts])

    return find


def find(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(doc_id, contaminated, items, matches) per document."""
    hits = matcher(documents, benchmark, limits)
    found = documents.select(F.col(id_col).alias("doc_id"), hits(F.col(text_col)).alias("matches"))
    items: Column = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), items.alias("items"), "matches")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Documents without a match, all columns."""
    hits = matcher(documents, benchmark, limits)
    judged = documents.select(F.struct("*").alias("d"), hits(F.col("text")).alias("m"))
    return judged.filter(F.size("m") == 0).select("d.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
