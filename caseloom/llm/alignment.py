"""Alignment of two tokenizers' tokens over the same bytes, by galloping intersection.

Both tokenizers cut the bytes of a space and the text.  A token is known by the
byte offset at which it ends, so each tokenizer gives an ascending list of ends.
Of two lists the shorter drives: each of its ends gallops into the longer, by
steps that double until they pass it, then by halving the last step.  The rank
found says how many ends of the longer list lie before it, and whether the end is
common.  Common ends cut both token lists into groups; ranks of neighbouring ends
differ by the tokens that overlap the bytes between them, which gives the links.

The lists of a batch of documents are laid end to end, so numpy takes each step
for many ends at once: every 16th end is placed first, and the others start from
the rank of the one placed before them.

Corpus-wide counts of linked id pairs come from one row per pair and block of
documents; Spark sums them, takes the best count of each second id, and joins
them back to the pairs of each block.  A document keeps its pairs as ranks in its
block's list.  A pair is at most once in a block, so frequent pairs are no hot
keys, and no pair table is sent to all executors.

Defined cases: a null or empty text, or one whose joined tokens of either kind
are not its bytes after a space, has no tokens: zeros and an empty digest; a text
that one tokenizer takes as unknown is such a text; special tokens' strings are
plain text; repeated rows and null ids are aligned like any other row; other
columns are left out; an empty table gives an empty result.  A long text is
encoded in parts cut at single spaces; only its own token lists are held at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import land, table
from caseloom.llm.tokens import Encoder, vocabulary_path
from caseloom.llm.tokens import byte_alphabet as _byte_level

PIECES = "piece_bpe_32k.model"
#: Text bytes whose pairs are counted together, and characters encoded and aligned together.
BLOCK_BYTES, BATCH_CHARS = 12 << 20, 1 << 20
#: Characters of a part of a long text.
PART_CHARS = 1 << 16
#: Words the byte-level encoder remembers per worker.
REMEMBERED = 400_000
#: Ends between two that are placed first.
STRIDE = 16
_SPACE = re.compile(r"(?<=[^ ]) (?=[^ ])")


class ByteLevel:
    """Ids and bytes of the byte-level vocabulary; the text is encoded after a space."""

    def __init__(self, path: str | None = None):
        self.encoder = Encoder(vocabulary_path(path))
        self.encoder.tokenizer.encode_special_tokens = True
        self.encoder.added, self.encoder.remembered = [], REMEMBERED
        if self.encoder.tokenizer.normalizer is not None:
            raise ValueError("the byte-level vocabulary must keep its text as it is")
        names, alphabet = self.encoder.tokenizer.get_vocab(with_added_tokens=True), _byte_level()
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """A point before the space makes the text one that starts with a word; it is a token of its own and goes again."""
        return [np.frombuffer(ids, "<u4")[1:].astype(np.int64) for ids in self.encoder.encode([". " + t for t in texts])]


class Pieces:
    """Ids and bytes of the sentence pieces, which add the space themselves."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.model.id_to_piece, range(self.model.get_piece_size())))
        ]
        # parts can be cut at single spaces unless a piece goes on over one
        self.cuts = not any(re.search("[^▁]▁", self.model.id_to_piece(i)) for i in range(len(self.bytes)))

    def _parts(self, text: str) -> list[str]:
        if len(text) <= PART_CHARS or not self.cuts:
            return [text]
        out, start = [], 0
        while len(text) - start > PART_CHARS and (cut := _SPACE.search(text, start + PART_CHARS)):
            out.append(text[start : cut.start()])
            start = cut.end()
        return [*out, text[start:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self._parts(t) for t in texts]
        ids = iter(self.model.encode([p for ps in parts for p in ps], num_threads=1))
        return [np.array(next(ids) if len(ps) == 1 else [i for _ in ps for i in next(ids)], np.int64) for ps in parts]


def gallop(ends: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Rank of each of the ascending ``ends`` in ``longer``: how many of its ends are smaller."""
    rank, n = np.zeros(len(ends), np.int64), len(longer)
    fenced = np.append(longer, np.iinfo(longer.dtype).max)  # nothing is beyond the last
    stride = 1
    while stride * STRIDE < len(ends):
        stride *= STRIDE
    while stride:
        at = np.arange(0, len(ends), stride)
        want = ends[at]
        low = rank[at // (stride * STRIDE) * (stride * STRIDE)]  # placed in the round before; 0 in the first
        high, step = low.copy(), 1
        going = np.flatnonzero(fenced[high] < want)
        while len(going):
            h = high[going]
            low[going] = h + 1
            h = np.minimum(h + step, n)
            high[going] = h
            step *= 2
            going = going[fenced[h] < want[going]]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            below = longer[middle] < want[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
            open_ = open_[low[open_] < high[open_]]
        rank[at] = low
        stride //= STRIDE
    return rank


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A's tokens with a common end, B's likewise, A token and B token of each link), as positions.

    Both lists ascend and end alike.
    """
    swap = len(a_ends) > len(b_ends)
    short, long = (b_ends, a_ends) if swap else (a_ends, b_ends)
    rank = gallop(short, long)
    common = long[np.minimum(rank, len(long) - 1)] == short if len(long) else np.zeros(0, bool)
    first = np.concatenate([[0], (rank + common)[:-1]]) if len(rank) else rank
    count = rank - first + 1  # from the token after the last end up to the start, to the one that holds the end
    mine = np.repeat(np.arange(len(short)), count)
    other = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    at_short, at_long = np.flatnonzero(common), rank[common]
    return (at_long, at_short, other, mine) if swap else (at_short, at_long, mine, other)


class Aligner:
    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        self.size_b = len(self.b.bytes)
        marks = [(",", "|"), (",", ";")]
        self.words = np.array([f"{i}{m}".encode() for t, ms in zip((self.a, self.b), marks) for m in ms for i in range(len(t.bytes))], object)

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both kinds per text; none where the joined tokens are not a space and the text."""
        none = np.zeros(0, np.int64)
        utf8 = [t.encode(errors="replace") for t in texts]
        use = [i for i, t in enumerate(texts) if t and utf8[i].decode() == t]
        out = [(none, none)] * len(texts)
        for i, a, b in zip(use, self.a.encode([texts[i] for i in use]), self.b.encode([texts[i] for i in use])):
            # without a normaliser byte-level tokens join to what was encoded, so their length tells
            if self.sizes[0][a].sum() == len(utf8[i]) + 1 and b"".join(map(self.b.bytes.__getitem__, b.tolist())) == b" " + utf8[i]:
                out[i] = (a, b)
        return out

    def documents(self, texts: list[str]) -> tuple[pd.DataFrame, list[np.ndarray]]:
        """(counts and digest of each text, keys of its links: A id * vocabulary of B + B id)."""
        pairs = self.tokens(texts)
        n = [np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1)]
        ids = [np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1)]
        ends = [np.cumsum(s[i]) for s, i in zip(self.sizes, ids)]  # texts end to end: each ends at a common end
        ca, cb, la, lb = align(*ends)
        stops = [np.cumsum(c) for c in n]
        groups = np.diff(np.searchsorted(ca, stops[0]), prepend=0)
        links = np.diff(np.searchsorted(la, stops[0]), prepend=0)
        keys = ids[0][la] * self.size_b + ids[1][lb]
        digests = self._digests(ids, ca, cb, n)
        facts = pd.DataFrame({"n_a": n[0], "n_b": n[1], "n_groups": groups, "n_links": links, "groups_sha256": digests})
        return facts, np.split(keys, np.cumsum(links)[:-1]) if len(links) else []

    def _digests(self, ids: list[np.ndarray], ca: np.ndarray, cb: np.ndarray, n: list[np.ndarray]) -> list[str]:
        """sha256 of ``a1,a2|b1;..`` per text: each id is looked up with the mark that follows it."""
        va, vb = len(self.a.bytes), self.size_b
        marked = [ids[0].copy(), ids[1] + 2 * va]
        marked[0][ca] += va
        marked[1][cb] += vb
        sizes = [np.diff(c, prepend=-1) for c in (ca, cb)]
        before_a = np.repeat(np.cumsum(sizes[1]) - sizes[1], sizes[0])  # B tokens of earlier groups
        before_b = np.repeat(np.cumsum(sizes[0]), sizes[1])  # A tokens up to the group
        order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        order[np.arange(len(ids[0])) + before_a] = marked[0]
        order[np.arange(len(ids[1])) + before_b] = marked[1]
        out, at = [], 0
        for k in (n[0] + n[1]).tolist():
            out.append(hashlib.sha256(b"".join(self.words[order[at : at + k]].tolist())[:-1]).hexdigest() if k else "")
            at += k
        return out


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(a_path: str | None, b_path: str | None) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


class _Block:
    """Documents of a block until it is full."""

    def __init__(self, number: int):
        self.number, self.size, self.frames, self.pairs = number, 0, [], []

    def add(self, frame: pd.DataFrame, pairs: list[np.ndarray], size: int) -> None:
        self.frames.append(frame)
        self.pairs += [np.unique(p, return_counts=True) for p in pairs]
        self.size += size

    def close(self) -> pd.DataFrame:
        """Rows of the documents, and first one that lists the block's pairs and their counts."""
        docs = pd.concat(self.frames, ignore_index=True)
        keys, at = np.unique(np.concatenate([k for k, _ in self.pairs]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([c for _, c in self.pairs]), minlength=len(keys)).astype(np.int64)
        ranks = np.split(at.astype("<u4"), np.cumsum([len(k) for k, _ in self.pairs])[:-1])
        docs["ranks"] = [np.diff(r, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for r in ranks]
        docs["times"] = [c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for _, c in self.pairs]
        docs["keys"], docs["counts"] = None, None
        head = pd.DataFrame({c: [None] for c in docs.columns}, dtype=object)
        head.at[0, "keys"], head.at[0, "counts"] = keys, total
        out = pd.concat([head, docs.astype(object)], ignore_index=True)
        out["block"] = self.number
        return out


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def aligned(documents: DataFrame, id_col: str, text_col: str, a_path: str | None, b_path: str | None, block_bytes: int) -> DataFrame:
    """Landed (block, id, facts, ranks, times) per document, and (block, keys, counts) per block."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        block = _Block(number)
        for pdf in batches:
            texts = pdf["text"].tolist()
            starts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // BATCH_CHARS, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(texts)]):
                facts, pairs = tool.documents(texts[a:b])
                facts.insert(0, "id", pdf["id"].to_numpy(object)[a:b])
                block.add(facts, pairs, sum(map(len, texts[a:b])))
                if block.size >= block_bytes:
                    yield block.close()
                    block = _Block(block.number + 1)
        if block.frames:
            yield block.close()

    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = (
        f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ranks binary, times binary,"
        " keys array<long>, counts array<long>, block long"
    )
    return land(rows.mapInPandas(run, schema), "aligned")


def pair_counts(parts: DataFrame, size_b: int) -> DataFrame:
    """(key, n, best): links of each id pair in the corpus, and whether no pair with the same B id has more."""
    each = parts.filter("keys is not null").select(F.explode(F.arrays_zip("keys", "counts")).alias("p"))
    n = land(each.groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.counts").alias("n")), "pairs")
    most = n.groupBy((F.col("key") % size_b).alias("b")).agg(F.max("n").alias("most"))
    return n.join(most, n["key"] % size_b == most["b"]).select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def _scored(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Adds n_best and count_sum; ``pairs`` are those of the block."""
    pairs = pairs.sort_values("key")
    n, best = pairs["n"].to_numpy(object), pairs["best"].to_numpy(np.int64)
    if not len(n) or sum(n) < 1 << 31:  # times stay below 2^32, so products fit 64 bits
        n = n.astype(np.int64)
    out = docs.drop(columns=["ranks", "times", "block"])
    got = [(np.cumsum(_numbers(r), dtype=np.int64), _numbers(t).astype(np.int64)) for r, t in zip(docs["ranks"], docs["times"])]
    out["n_best"] = [int((best[r] * t).sum()) for r, t in got]
    out["count_sum"] = [int((n[r] * t).sum()) for r, t in got]
    return out


def align_tokens(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row."""
    size_b = len(Pieces(b_path).bytes)
    parts = aligned(documents, id_col, text_col, a_path, b_path, block_bytes)
    counts = pair_counts(parts, size_b)
    wanted = parts.filter("keys is not null").select("block", F.explode("keys").alias("key"))
    answers = wanted.join(counts, "key").select(F.col("block").alias("of"), "key", "n", "best")
    docs = parts.filter("keys is null").drop("keys", "counts")
    kind = docs.schema["id"].dataType.simpleString()
    out = docs.groupBy("block").cogroup(answers.groupBy("of")).applyInPandas(
        _scored, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    )
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))
