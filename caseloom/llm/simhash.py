"""SimHash near-duplicates, linked exactly through a vantage-point tree.

Fingerprints within ``radius`` bits differ by at most ``radius // 2`` in one of
their 32-bit halves.  For each half there is a tree: level i sorts fingerprints
into rings by their Hamming distance to vantage point i, so a leaf is a vector
of ring numbers.  The triangle bound says that a neighbour at distance s lies at
most s rings away at every level, and the parity of Hamming distances leaves
only ring changes of s, s-2, ..: all other branches are pruned.  A fingerprint
is stored in its own leaf and asks the leaves that its ball overlaps; one of
two opposite leaves suffices, as the partner asks the other.

Only distinct fingerprints are searched, so exact copies cost nothing.  A leaf
above ``leaf`` rows is cut into blocks, each of whose pairs meet in one of many
tasks; nothing is dropped.

Defined cases: a null text counts as empty and has fingerprint zero; fingerprint
zero links like any other; a null id never becomes a component id unless all ids
of its component are null; repeated rows stay repeated; other columns are left
out of the result; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import fresh_path, land, table
from caseloom.llm.components import connected_components

#: Bound of the sample that chooses vantage points, and rows that a leaf should hold.
SAMPLE = 512
LEAF = 1024


def simhash(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint, as a signed number."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    ones, n = np.zeros(64, np.int64), 0
    digest = map(xxhash.xxh64_intdigest, shingles, itertools.repeat(42))
    while len(h := np.fromiter(itertools.islice(digest, 1 << 15), np.uint64)):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return documents.select(F.col(id_col).alias("doc_id"), of(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"))


def levels_for(count: int, leaf: int = LEAF) -> int:
    """Levels of the tree: about a tenth of a leaf's rows share a ring of the next level."""
    return max(3, int(np.ceil(np.log10(max(count, 1) / leaf))) + 1)


def ring_steps(levels: int, reach: int) -> list[tuple[int, ...]]:
    """Ring changes that the triangle bound and parity allow, one of each opposite two."""
    found = {(0,) * levels}
    for s in range(reach + 1):
        found |= set(itertools.product(range(-s, s + 1, 2), repeat=levels))
    return sorted(x for x in found if x >= (0,) * levels)


def choose_vantage(sample: np.ndarray, levels: int) -> list[int]:
    """From the sampled halves, those that part the sample into the most even rings, one after another."""
    if not len(sample):
        sample = np.zeros(1, np.uint32)
    rings = np.bitwise_count(sample[:, None] ^ sample[None, :]).astype(np.int64)
    joint, chosen = np.zeros(len(sample), np.int64), []
    for _ in range(levels):
        best, best_cost = 0, None
        for c in range(min(len(sample), 64)):
            counts = np.unique(joint * 64 + rings[c], return_counts=True)[1]
            cost = int((counts**2).sum())
            if best_cost is None or cost < best_cost:
                best, best_cost = c, cost
        chosen.append(int(sample[best]))
        joint = np.unique(joint * 64 + rings[best], return_inverse=True)[1].astype(np.int64)
    return chosen


def _pairs(data: np.ndarray, asks: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius; in its own leaf a fingerprint takes only larger partners."""
    found_a, found_b = [], []
    for at in range(0, len(asks), 2048):
        q, o = asks[at : at + 2048], own[at : at + 2048]
        near = np.bitwise_count(q[:, None] ^ data[None, :]) <= radius
        i, j = np.nonzero(near)
        keep = np.where(o[i], q[i] < data[j], q[i] != data[j])
        found_a.append(q[i][keep])
        found_b.append(data[j][keep])
    return np.concatenate(found_a), np.concatenate(found_b)


def whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, block edges) of sorted batches; the last block of a batch waits for the next one."""
    rest: pd.DataFrame | None = None
    for batch in itertools.chain(batches, [None]):
        held = [x for x in (rest, batch) if x is not None and len(x)]
        if not held:
            continue
        pdf = pd.concat(held, ignore_index=True)
        block = pdf["block"].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        if batch is not None:
            edges = edges[:-1]
        rest = pdf.iloc[edges[-1] :]
        yield pdf, edges


def _search(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, edges in whole_blocks(batches):
            fp, role = pdf["fp"].to_numpy().view(np.uint64), pdf["role"].to_numpy()
            a, b = [], []
            for s, e in itertools.pairwise(edges):
                r, f = role[s:e], fp[s:e]
                data, asks = f[r == 0], r > 0
                if len(data) and asks.any():
                    x, y = _pairs(data, f[asks], r[asks] == 1, radius)
                    a.append(x)
                    b.append(y)
            if a:
                x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def sampled(distinct: DataFrame, columns: list[str], key: str) -> list:
    """At most ``SAMPLE`` rows by hash, from which vantage points are chosen."""
    return distinct.select(*columns, key).orderBy(F.xxhash64(key), key).limit(SAMPLE).collect()


def leaves_of(distinct: DataFrame, sample: np.ndarray, levels: int, radius: int, half: int, tree: int, carried: list[str]) -> DataFrame:
    """(fp, carried, leaf, role): every fingerprint in its own leaf (role 0) and asking others (1 its own, 2 further)."""
    own = (0,) * levels
    halves = (sample.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
    bits = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(0xFFFFFFFF)
    leaf_no = F.lit(tree).cast("long")
    for v in choose_vantage(halves.astype(np.uint32), levels):
        leaf_no = leaf_no * 64 + F.bit_count(bits.bitwiseXOR(F.lit(v).cast("long"))) + reach_pad(radius)
    place = lambda step: int(sum(s * 64 ** (levels - 1 - k) for k, s in enumerate(step)))
    roles = [(0, 0)] + [(place(s), 1 if s == own else 2) for s in ring_steps(levels, radius // 2)]
    return distinct.select("fp", *carried, leaf_no.alias("leaf")).select(
        "fp", *carried, F.explode(F.array(*[F.struct((F.col("leaf") + p).alias("leaf"), F.lit(r).alias("role")) for p, r in roles])).alias("x")
    ).select("fp", *carried, "x.leaf", "x.role")


def blocks_of(asked: DataFrame, leaf: int, key: str, columns: list[str]) -> DataFrame:
    """(block, columns, role), dealt by block: a leaf above ``leaf`` rows is cut so that each of its pairs meets in one block."""
    sizes = asked.groupBy("leaf").agg(
        F.count(F.when(F.col("role") == 0, 1)).alias("stored"), F.count(F.when(F.col("role") > 0, 1)).alias("asking")
    ).filter(f"stored > 0 and (stored > {leaf} or asking > {4 * leaf})")
    cut = sizes.select(
        "leaf", F.ceil(F.col("stored") / leaf).cast("int").alias("nd"), F.ceil(F.col("asking") / (4 * leaf)).cast("int").alias("nq")
    )
    joined = asked.join(cut, "leaf", "left")
    one, mine = F.lit(1), F.xxhash64(key)
    nd, nq = F.coalesce("nd", one), F.coalesce("nq", one)
    others = F.when(F.col("role") == 0, nq).otherwise(nd)
    blocks = joined.select(
        *columns, "role", "leaf", nd.alias("nd"), nq.alias("nq"), F.explode(F.sequence(F.lit(0), others - 1)).alias("k")
    ).select(
        *columns, F.col("role").cast("int").alias("role"),
        F.xxhash64(
            "leaf",
            F.when(F.col("role") == 0, F.pmod(mine, F.col("nd"))).otherwise(F.col("k").cast("long")),
            F.when(F.col("role") == 0, F.col("k").cast("long")).otherwise(F.pmod(mine, F.col("nq"))),
        ).alias("block"),
    )
    return blocks.repartition("block").sortWithinPartitions("block").select("block", *columns, "role")


def linked_pairs(distinct: DataFrame, radius: int = 2, leaf: int = LEAF, levels: int | None = None) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct fingerprints ``fp`` that differ in at most ``radius`` bits."""
    levels = levels or levels_for(distinct.count(), leaf)
    sample = np.array([r["fp"] for r in sampled(distinct, [], "fp")], np.int64)
    asked = leaves_of(distinct, sample, levels, radius, 0, 0, []).union(leaves_of(distinct, sample, levels, radius, 1, 1, []))
    pairs = blocks_of(asked, leaf, "fp", ["fp"]).mapInPandas(_search(radius), "a long, b long")
    return pairs.distinct()


def reach_pad(radius: int) -> int:
    """Keeps ring numbers of asked leaves from falling below zero."""
    return radius // 2


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links, one row per document."""
    marked = land(fingerprints(documents, id_col, text_col, shingle), "fingerprints")
    distinct = land(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = connected_components(linked_pairs(distinct.select("fp"), radius))
    grouped = land(
        distinct.join(links, distinct["fp"] == links["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")),
        "grouped",
    )
    named = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = grouped.join(named, "root").select("fp", "component_id")
    return marked.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_first(documents: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component, all columns: the row with the smallest id.

    Rows are told apart by a number of their own, so repeated and null ids keep
    exactly one row of their component as well.
    """
    spark = documents.sparkSession
    path = fresh_path(spark, "rows")
    documents.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    groups = land(near_duplicates(rows.select(F.struct("doc_id", "__row").alias("key"), "text"), "key", "text", shingle, radius), "groups")
    losers = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id")["__row"].alias("__row"))
    return rows.join(losers, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
