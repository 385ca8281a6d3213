"""Token-id files in canonical, length-limited Huffman code.

Global counts of all ids give code lengths by package-merge (at most
``MAX_BITS``); canonical codes follow from the lengths alone.  A file holds the
lengths and then frames of whole documents.  A frame is a table of its
documents, the bit offset of every block of ``BLOCK`` ids, and the bit stream;
blocks are independent, so a reader decodes all blocks of a frame in step by
table look-ups over numpy arrays, and frames are read by different tasks.

File: ``MAGIC``, u32 size and zlib bytes of the code lengths by id (u8 each),
frames, then a footer (u64 offset and u32 size of each frame, u32 their number,
``MAGIC``).  Frame: three u32 (documents' table, checkpoints, ids), zlib JSON of
[doc_id, tokens] pairs, zlib u64 bit offsets, bits.  All little-endian.

Defined cases: a null or empty text is its end id alone; null ids come first;
repeated rows are written in any order among themselves; other columns are left
out; an empty table writes no frame and gives an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import fresh_path, land, table, total
from caseloom.llm.files import open_new, read_range
from caseloom.llm.tokens import encode_slices, forget, vocabulary_path

MAGIC = b"CLHUF001"
MAX_BITS = 18
BLOCK = 512
FRAME_TOKENS = 1 << 20
FILE_BYTES = 128 << 20


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need codes of more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        merged = np.concatenate([leaf, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    length, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every window of ``MAX_BITS`` bits."""
    codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    ids, size = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.uint8)
    spans = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    filled = int(spans.sum())
    ids[:filled], size[:filled] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    assert not len(order) or codes[order[0]] == 0
    return ids, size


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of every block)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    value = codes[ids].astype(np.int64) << (32 - size - (begins & 7))
    byte, out = begins >> 3, np.zeros((bits + 7) // 8 + 4, np.int64)
    for k in range(4):  # the codes share no bit, so sums are unions
        out += np.bincount(byte + k, weights=(value >> (24 - 8 * k)) & 255, minlength=len(out)).astype(np.int64)
    return out[: (bits + 7) // 8].astype(np.uint8).tobytes(), begins[::BLOCK]


def decode_ids(raw: bytes, offsets: np.ndarray, count: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All blocks of a frame in step: one id of each block at a time."""
    if not count:
        return np.zeros(0, np.uint32)
    ids, size = tables
    data = np.frombuffer(raw + bytes(8), np.uint8).astype(np.int64)
    words = (data[:-4] << 32) | (data[1:-3] << 24) | (data[2:-2] << 16) | (data[3:-1] << 8) | data[4:]
    at, blocks = offsets.astype(np.int64).copy(), len(offsets)
    out, last = np.zeros((BLOCK, blocks), np.uint32), count - (blocks - 1) * BLOCK
    for step in range(BLOCK):
        live = blocks if step < last else blocks - 1
        if not live:
            break
        here = at[:live]
        window = (words[here >> 3] >> (40 - MAX_BITS - (here & 7))) & ((1 << MAX_BITS) - 1)
        out[step, :live] = ids[window]
        here += size[window]
    return out.T.reshape(-1)[:count]


def write_frame(docs: list, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    bits, offsets = encode_ids(ids, lengths, codes)
    head = zlib.compress(json.dumps(docs).encode(), 1)
    marks = zlib.compress(offsets.astype("<u8").tobytes(), 1)
    return struct.pack("<III", len(head), len(marks), len(ids)) + head + marks + bits


def read_frame(raw: bytes, tables) -> tuple[list, np.ndarray]:
    head, marks, count = struct.unpack_from("<III", raw)
    docs = json.loads(zlib.decompress(raw[12 : 12 + head]))
    offsets = np.frombuffer(zlib.decompress(raw[12 + head : 12 + head + marks]), "<u8")
    return docs, decode_ids(raw[12 + head + marks :], offsets, count, tables)


def file_lengths(uri: str) -> np.ndarray:
    size = struct.unpack("<I", read_range(uri, 8, 4))[0]
    return np.frombuffer(zlib.decompress(read_range(uri, 12, size)), np.uint8)


def encode_documents(documents: DataFrame, id_col: str, text_col: str, end_id: int, path: str) -> DataFrame:
    """(doc_id, ids) with ids as bytes, two of them per id where the vocabulary allows; landed."""
    width = "<u2" if end_id < 1 << 16 and vocabulary_size(path) <= 1 << 16 else "<u4"

    # an Arrow function, so that no more texts than a slice are Python strings at a time
    def encode(texts: pa.Array) -> pa.Array:
        end, plain = np.array([end_id], "<u4").tobytes(), (t.as_py() for t in texts)
        return pa.array((np.frombuffer(ids + end, "<u4").astype(width).tobytes() for ids in encode_slices(plain, path)), pa.binary())

    encoded = F.arrow_udf(encode, T.BinaryType())
    coded = documents.select(F.col(id_col).alias("doc_id"), encoded(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))
    return land(coded, "ids"), width


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


#: Ids counted in one step.
COUNT_IDS = 1 << 20


def id_counts(coded: DataFrame, width: str) -> np.ndarray:
    """Global counts of ids; what reaches the driver is bounded by the vocabulary."""

    def count(batches):
        forget()
        sums, held, n = np.zeros(1, np.int64), [], 0

        def add():
            nonlocal sums, held, n
            if held:
                got = np.bincount(np.concatenate(held), minlength=len(sums))
                got[: len(sums)] += sums
                sums, held, n = got, [], 0

        for batch in batches:
            for ids in batch.column(0):
                held.append(np.frombuffer(ids.as_buffer(), width))
                n += len(held[-1])
                if n >= COUNT_IDS:
                    add()
        add()
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["id", "n"])

    rows = coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_files(coded: DataFrame, width: str, lengths: np.ndarray, folder: str, frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """Write the files in ascending order of id and land their manifest, a row per frame."""
    spark = coded.sparkSession
    files = max(2 * spark.sparkContext.defaultParallelism, total(coded, F.sum(F.octet_length("ids"))) // FILE_BYTES + 1)
    sent = spark.sparkContext.broadcast(lengths)  # at most a byte per id of the vocabulary

    def write(batches) -> Iterator[pa.RecordBatch]:
        forget()
        sizes = sent.value
        codes, part = canonical_codes(sizes), TaskContext.get().partitionId()
        stream, uri, at, frames, done = None, None, 0, [], 0
        docs, held, n = [], [], 0

        def flush():
            nonlocal stream, uri, at, docs, held, n, done
            if stream is None:
                stream, uri = open_new(folder, f"part-{part:06d}")
                packed = zlib.compress(sizes.tobytes())
                stream.write(MAGIC + struct.pack("<I", len(packed)) + packed)
                at = 12 + len(packed)
            raw = write_frame(docs, np.concatenate(held), sizes, codes)
            stream.write(raw)
            frames.append((uri, part, at, len(raw), done, n))
            at, done = at + len(raw), done + n
            docs, held, n = [], [], 0

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(ids.as_buffer(), width)
                docs.append([doc_id, len(own)])
                held.append(own)
                n += len(own)
                if n >= frame_tokens:
                    flush()
        if docs:
            flush()
        if stream is not None:
            for f in frames:
                stream.write(struct.pack("<QI", f[2], f[3]))
            stream.write(struct.pack("<I", len(frames)) + MAGIC)
            stream.close()
        names = ["uri", "part", "at", "size", "before", "tokens"]
        kinds = [pa.string()] + [pa.int64()] * 5
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in frames], t) for k, t in enumerate(kinds)], names=names)

    ordered = coded.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    return land(ordered.mapInArrow(write, "uri string, part long, at long, size long, before long, tokens long"), "manifest")


def read_files(manifest: DataFrame, id_type: T.DataType) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, uri) decoded from the files, a task per group of frames."""
    spark = manifest.sparkSession
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    frames = manifest.join(bases, "part").select("uri", "at", "size", (F.col("base") + F.col("before")).alias("first"))
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type.simpleString()]

    def read(batches) -> Iterator[pa.RecordBatch]:
        forget()
        known: tuple[str, tuple] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if known is None or known[0] != row["uri"]:
                    known = (row["uri"], decode_table(file_lengths(row["uri"])))
                docs, ids = read_frame(read_range(row["uri"], row["at"], row["size"]), known[1])
                names, starts, sizes, crcs, at = [], [], [], [], 0
                raw = ids.astype("<u4").tobytes()
                for doc_id, n in docs:
                    names.append(doc_id)
                    starts.append(row["first"] + at)
                    sizes.append(n)
                    crcs.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, arrow), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    tasks = max(2 * spark.sparkContext.defaultParallelism, manifest.count() // 16)
    spread = frames.repartition(tasks)
    return spread.mapInArrow(read, f"doc_id {id_type.simpleString()}, start long, n_tokens long, ids_crc32 long")


def write_and_read(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None,
    frame_tokens: int = FRAME_TOKENS,
) -> DataFrame:
    coded, width = encode_documents(documents, id_col, text_col, end_id, vocabulary_path(path))
    lengths = code_lengths(id_counts(coded, width))
    manifest = write_files(coded, width, lengths, fresh_path(documents.sparkSession, "huffman"), frame_tokens)
    return read_files(manifest, documents.schema[id_col].dataType)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"))
