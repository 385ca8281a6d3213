"""Removal of word windows that occur more than once, behind a count-min prefilter.

A window is ``window`` consecutive words of one document.  The first pass keeps
few things to count: of the word runs half as long inside a window, the one with
the smallest hash is its anchor.  Equal windows have equal anchors, so an anchor
is at least as frequent as any of its windows.  Each block of documents sketches
its anchors in ``DEPTH`` rows of counters; the sketches are cut in segments, the
segments of all blocks are merged by adding counters (2 is enough), and each
block gets back which of its counters reached 2.  The least counter of an anchor
never falls below the count of its windows, so a window whose estimate is 1
occurs once, and none that repeats is lost.

The second pass takes only windows with an estimate of 2 or more, groups their
128-bit hashes exactly and returns those found twice or more to their blocks;
the third removes the words they cover.

Blocks are bounded in bytes and send each anchor or window once with a mark for
more, so a passage or copy that fills a third of all rows adds one entry per
block, and segments and shards grow in number, not in size, with the input.
Nothing but the size of all texts is known to the driver.

Defined cases: a null or empty text has no words and gives zeros and the sha256
of nothing; a text shorter than a window keeps all words; repeated rows make all
windows of their text repeated; null ids are kept as they are; other columns are
left out; an empty table gives an empty result.  A text of any length is held by
the task of its block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.blocks import BLOCK_BYTES, blocked, packed, text_bytes, unpacked
from caseloom.llm.common import WHITE_CLASS, table

WINDOW = 35
#: Rows of the sketch, counters of a segment (as a power of two) and counters per anchor in all segments of a row.
DEPTH, SEGMENT_BITS, ROOM = 2, 22, 16
#: Windows expected per shard of the exact pass.
SHARD_WINDOWS = 4_000_000
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class Words:
    """Words of several texts in a row, with two hash lanes and the words left in each text."""

    def __init__(self, texts):
        self.parts = [t.encode(errors="surrogatepass").split() for t in texts]  # bytes split at \x20 and \x09-\x0D
        self.counts = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        lanes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for p in self.parts for w in p), "<u8").reshape(-1, 2)
        self.lanes = [np.ascontiguousarray(lanes[:, k]) for k in (0, 1)]
        self.ends = np.cumsum(self.counts)
        self.left = np.repeat(self.ends, self.counts) - np.arange(len(lanes))

    def runs(self, lane: int, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; the last n - 1 words start none."""
        piece, size, step = self.lanes[lane], 1, _BASE[lane]
        out, done = None, 0
        if len(piece) < n:
            return np.zeros(0, np.uint64)
        while True:
            if n & 1:
                if out is None:
                    out, done = piece, size
                else:
                    m = min(len(out), len(piece) - done)
                    out, done = out[:m] * step + piece[done : done + m], done + size
            n >>= 1
            if not n:
                return out
            piece, size = piece[:-size] * step + piece[size:], size * 2
            step = np.uint64(int(step) ** 2 & int(_TOP))


def _smallest(x: np.ndarray, n: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over each ``n`` consecutive values."""
    size = 1
    while 2 * size <= n:
        x, size = pick(x[:-size], x[size:]), 2 * size
    return pick(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each window, 0 where a window would cross texts; all anchors, one per place)."""
    gram = (window + 1) // 2
    span = window - gram + 1
    g = words.runs(0, gram)
    if len(g) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    g = ((g ^ (g >> np.uint64(31))) * _MIX[3]) | np.uint64(1)
    inside = words.left[: len(g)] >= gram
    low = _smallest(np.where(inside, g, _TOP), span)
    low[words.left[: len(low)] < window] = 0
    high = _smallest(np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)]), span, np.maximum)
    return low, g[inside & (high == g)]


def counters(items: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (((items ^ (items >> np.uint64(32))) * _MIX[row]) ^ _MIX[3 - row]) >> np.uint64(64 - bits)


def _segments(cells: np.ndarray) -> Iterator[tuple[int, int, int]]:
    segment = cells >> np.uint64(SEGMENT_BITS)
    edges = np.flatnonzero(np.diff(segment, prepend=segment[:1] + np.uint64(1), append=segment[-1:] + np.uint64(1))) if len(cells) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(segment[a]), a, b


SKETCH = "depth int, segment long, block long, cells binary, more binary"
HOT = "block long, depth int, segment long, cells binary"
KEYS = "block long, shard long, keys binary, more binary"


def sketch_block(pdf: pd.DataFrame, window: int, bits: int) -> pd.DataFrame:
    """The block's sketch, row by row and segment by segment."""
    _, places = anchors(Words(pdf["text"]), window)
    items, n = np.unique(places, return_counts=True)
    out, low = [], np.uint64((1 << SEGMENT_BITS) - 1)
    for row in range(DEPTH):
        cells, at = np.unique(counters(items, row, bits), return_inverse=True)
        more = np.bincount(at, weights=n, minlength=len(cells)) > 1
        for segment, a, b in _segments(cells):
            out.append((row, segment, pdf["block"].iloc[0], packed((cells[a:b] & low).astype(np.uint32)), np.packbits(more[a:b]).tobytes()))
    return pd.DataFrame(out, columns=["depth", "segment", "block", "cells", "more"])


def merge_segment(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adds up one segment of all blocks and returns to each block its counters that reach 2."""
    count = np.zeros(1 << SEGMENT_BITS, np.uint8)
    for cells, more in zip(pdf["cells"], pdf["more"]):
        c = unpacked(cells, np.uint32)
        count[c] = np.minimum(2, count[c] + 1 + np.unpackbits(np.frombuffer(more, np.uint8), count=len(c)))
    out = []
    for block, cells in zip(pdf["block"], pdf["cells"]):
        c = unpacked(cells, np.uint32)
        hot = c[count[c] >= 2]
        if len(hot):
            out.append((block, packed(hot)))
    found = pd.DataFrame(out, columns=["block", "cells"])
    return found.assign(depth=pdf["depth"].iloc[0], segment=pdf["segment"].iloc[0])[["block", "depth", "segment", "cells"]]


def _held(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(x), bool)
    return found[np.minimum(np.searchsorted(found, x), len(found) - 1)] == x


def estimated_repeated(words: Words, hot: pd.DataFrame, window: int, bits: int) -> np.ndarray:
    """Whether each window's anchor has an estimated count of 2 or more."""
    low, places = anchors(words, window)
    items = np.unique(places)
    for row in range(DEPTH):
        mine = hot[hot["depth"] == row]
        cells = [unpacked(c, np.uint32).astype(np.uint64) + np.uint64(s << SEGMENT_BITS) for s, c in zip(mine["segment"], mine["cells"])]
        items = items[_held(counters(items, row, bits), np.sort(np.concatenate(cells)) if cells else np.zeros(0, np.uint64))]
    return (low != 0) & _held(low, items)


def candidate_keys(docs: pd.DataFrame, hot: pd.DataFrame, window: int, bits: int, shards: int) -> pd.DataFrame:
    """Hashes of the block's windows that are estimated repeated, once each, by shard."""
    columns, out = ["block", "shard", "keys", "more"], []
    if not len(docs) or not len(hot):
        return pd.DataFrame(out, columns=columns)
    words = Words(docs["text"])
    at = np.flatnonzero(estimated_repeated(words, hot, window, bits))
    a, b = words.runs(0, window)[at], words.runs(1, window)[at]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    more = np.diff(np.append(starts, len(a))) > 1
    a, b = a[starts], b[starts]
    shard = (a >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    edges = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    for s in np.flatnonzero(np.diff(edges)):
        i, j = edges[s], edges[s + 1]
        out.append((docs["block"].iloc[0], s, np.stack([a[i:j], b[i:j]]).tobytes(), np.packbits(more[i:j]).tobytes()))
    return pd.DataFrame(out, columns=columns)


def _pair(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64).reshape(2, -1)


def group_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact counts of one shard's window hashes; to each block those found twice or more."""
    pairs = [_pair(k) for k in pdf["keys"]]
    sizes = [p.shape[1] for p in pairs]
    both = np.concatenate(pairs, axis=1)
    n = 1 + np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=k) for m, k in zip(pdf["more"], sizes)]).astype(np.int64)
    order = np.lexsort((both[1], both[0]))
    a, b = both[0][order], both[1][order]
    starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    repeated = np.empty(len(a), bool)
    repeated[order] = np.repeat(np.add.reduceat(n[order], starts) > 1, np.diff(np.append(starts, len(a))))
    out, at = [], 0
    for block, pair, k in zip(pdf["block"], pairs, sizes):
        found = pair[:, repeated[at : at + k]]
        at += k
        if found.shape[1]:
            out.append((block, found.tobytes()))
    return pd.DataFrame(out, columns=["block", "keys"])


def covered(words: Words, found: list[bytes], window: int) -> np.ndarray:
    """Words inside a window whose hash is among ``found``."""
    out = np.zeros(len(words.left), bool)
    a, b = words.runs(0, window), words.runs(1, window)
    if not found or not len(a):
        return out
    keys = np.concatenate([_pair(k) for k in found], axis=1)
    keys = keys[:, np.lexsort((keys[1], keys[0]))]
    first = np.searchsorted(keys[0], a)
    hit = np.zeros(len(a), bool)
    for step in range(int(np.max(np.unique(keys[0], return_counts=True)[1]))):  # 1, but for equal first halves
        at = np.minimum(first + step, keys.shape[1] - 1)
        hit |= (keys[0][at] == a) & (keys[1][at] == b)
    hit &= words.left[: len(a)] >= window
    # +1 where a window starts, -1 after it ends: positive sums are covered
    edge = np.zeros(len(out) + 1, np.int32)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + window, -1)
    return np.cumsum(edge[:-1]) > 0


def cleaned(docs: pd.DataFrame, found: pd.DataFrame, window: int) -> pd.DataFrame:
    """(id, n_words, n_removed, kept): the words that stay, joined by one space, as bytes."""
    words = Words(docs["text"])
    gone = covered(words, list(found["keys"]), window)
    sums = np.concatenate([[0], np.cumsum(gone)])
    begins = words.ends - words.counts
    removed = sums[words.ends] - sums[begins]
    kept = [
        b" ".join(p) if not r else b" ".join(w for w, g in zip(p, gone[s : s + len(p)]) if not g)
        for p, s, r in zip(words.parts, begins.tolist(), removed.tolist())
    ]
    return pd.DataFrame({"id": docs["id"], "n_words": words.counts, "n_removed": removed, "kept": kept})


def repeated_windows(rows: DataFrame, size: int, window: int = WINDOW) -> DataFrame:
    """(block, keys): hashes of windows that occur twice or more, per block of ``rows`` that holds them."""
    expected = size // 6 + 1
    anchor_count = 4 * expected // (window + 3) + 1
    bits = max(SEGMENT_BITS, math.ceil(math.log2(ROOM * anchor_count)))
    shards = max(2 * rows.sparkSession.sparkContext.defaultParallelism, expected // SHARD_WINDOWS)
    sketches = rows.groupBy("block").applyInPandas(lambda pdf: sketch_block(pdf, window, bits), SKETCH)
    hot = sketches.groupBy("depth", "segment").applyInPandas(merge_segment, HOT)

    def keys(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return candidate_keys(docs, found, window, bits, shards)

    candidates = rows.groupBy("block").cogroup(hot.groupBy("block")).applyInPandas(keys, KEYS)
    return candidates.groupBy("shard").applyInPandas(group_shard, "block long, keys binary")


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(``id_col``, n_words, n_removed, kept_sha256[, kept]) per row; ``kept`` is the text that stays."""
    size = text_bytes(documents, text_col)
    rows = blocked(documents, id_col, text_col, size, block_bytes)
    found = repeated_windows(rows, size, window)
    kind = rows.schema["id"].dataType.simpleString()

    def clean(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = cleaned(docs, answers, window)
        out["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in out["kept"]]
        out["kept"] = [k.decode(errors="replace") for k in out["kept"]] if keep_text else None
        return out

    schema = f"id {kind}, n_words long, n_removed long, kept string, kept_sha256 string"
    out = rows.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(clean, schema)
    columns = [F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256"]
    return out.select(*columns, *(["kept"] if keep_text else []))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def sql(window: int = WINDOW) -> str:
    """Groups every window as text; words are covered by the last repeated window that starts at or before them."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[{WHITE_CLASS}]+'), lambda w: w <> '') AS words FROM documents),
placed AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
windows AS (SELECT r, i, md5(array_to_string(words[i:i + {window - 1}], ' ')) AS h
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - {window - 1})) AS i FROM docs WHERE len(words) >= {window})),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, i FROM windows WHERE h IN (SELECT h FROM twice)),
marked AS (SELECT p.r, p.i, p.word, max(s.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM placed p LEFT JOIN starts s ON p.r = s.r AND p.i = s.i),
per AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(p.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(p.kept, '')) AS kept_sha256 FROM docs d LEFT JOIN per p ON d.r = p.r"""
