"""Substring dedup, centroid clustering and token alignment against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import alignment, clusters, substrings

SCHEMA = "doc_id long, text string, block long, keys string, cluster string, id string, n_words long"


def prose(seed: int, n: int, kinds: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


def plain_removal(texts, window):
    """Every window as a tuple of words, counted in one dictionary."""
    split = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def passages():
    shared, nearly = prose(1, 60), prose(2, 36)
    rows = [
        prose(3, 50) + shared + prose(4, 40), shared + prose(5, 10), prose(6, 30) + shared[:34], prose(7, 300), prose(7, 300),
        ["again"] * 36, ["again"] * 35, ["once"] * 200, nearly, nearly[:35] + ["other"], nearly[:34] + ["last"], prose(8, 34), prose(8, 34),
        prose(9, 80) * 2, prose(10, 6000), prose(11, 3000) + prose(10, 6000)[2000:2100],
    ]
    return [" ".join(r) for r in rows] + [None, "", " \n\t\x0b\x0c\r ", "a b", "ü x " * 40, "ü x " * 40]


def rows_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, 7, "k", "c", "i", 0) for i, t in zip(ids, texts)], SCHEMA)


@pytest.mark.parametrize("block_bytes", [200, 20_000, 8 << 20])
def test_windows_that_repeat_are_removed(spark, passages, block_bytes):
    got = substrings.remove_repeats(rows_of(spark, passages).repartition(3), block_bytes=block_bytes).collect()
    want = plain_removal(passages, 35)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == dict(enumerate(want))
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_removal_with_null_and_repeated_ids_and_no_rows(spark):
    text = " ".join(prose(1, 40))
    got = substrings.remove_repeats(rows_of(spark, [text, text, text, "x y"], [None, 3, 3, None])).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [(0, 2, 0), (0, 40, 40), (3, 40, 40), (3, 40, 40)]
    assert substrings.remove_repeats(rows_of(spark, ["x"]).limit(0)).collect() == []


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=5), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_no_repeated_window_is_estimated_once(texts, window):
    """The steps of one block each, chained by hand: small alphabets make many ties and periods."""
    docs = [pd.DataFrame({"block": [k], "id": [k], "text": [" ".join(t)]}) for k, t in enumerate(texts)]
    bits = 24
    sketch = pd.concat([substrings.sketch_block(d, window, bits) for d in docs])
    hot = [substrings.merge_segment(g) for _, g in sketch.groupby(["depth", "segment"])]
    hot = pd.concat(hot) if hot else pd.DataFrame(columns=["block", "depth", "segment", "cells"])
    keys = pd.concat([substrings.candidate_keys(d, hot[hot["block"] == k], window, bits, 2) for k, d in enumerate(docs)])
    found = [substrings.group_shard(g) for _, g in keys.groupby("shard")]
    found = pd.concat(found) if found else pd.DataFrame(columns=["block", "keys"])
    got = [substrings.cleaned(d, found[found["block"] == k], window).iloc[0] for k, d in enumerate(docs)]
    want = plain_removal([" ".join(t) for t in texts], window)
    assert [(g["n_words"], g["n_removed"], hashlib.sha256(g["kept"]).hexdigest()) for g in got] == want


def test_the_prefilter_leaves_most_windows_out():
    docs = pd.DataFrame({"block": [0, 0], "id": [1, 2], "text": [" ".join(prose(1, 20_000, 10**6)), " ".join(prose(2, 50) + prose(1, 20_000, 10**6)[500:600])]})
    hot = pd.concat([substrings.merge_segment(g) for _, g in substrings.sketch_block(docs, 35, 26).groupby(["depth", "segment"])])
    words = substrings.Words(docs["text"])
    marked = substrings.estimated_repeated(words, hot, 35, 26)
    assert 2 * 66 <= marked.sum() < 300


def test_packed_numbers_come_back():
    for dtype in (np.uint32, np.uint64):
        x = np.unique(np.random.default_rng(1).integers(0, 1 << 31, 1000)).astype(dtype)
        assert (substrings.unpacked(substrings.packed(x), dtype) == x).all()


# --- clusters ----------------------------------------------------------------
VECTORS = "vec_id long, embedding array<double>, cluster string, id string, v string, distance string"


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, [min(max(math.floor(64 * x), -(1 << 62)), 1 << 62) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min(range(len(cents)), key=lambda c: (square(v, cents[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)].append(v)
        cents = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if groups[c] else cents[c] for c in range(len(cents))]
    placed = [(i, near(v), square(v, cents[near(v)])) for i, v in kept]
    within = Counter()
    for _, c, d in placed:
        within[c] += d
    largest = (1 << 63) - 1
    return sorted(((i, c, min(d, largest), min(within[c], largest), min(sum(within.values()), largest),
                    hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in placed), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e7, 1e15])
def test_clusters_equal_a_comparison_with_every_centroid(spark, scale):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, 0.0, 0.25, 1.0, r.random()]) * (scale if i % 3 else 1) for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[8][1]), (7, rows[8][1]), (None, [0.0, 0.0, 0.0, 0.0]), (400, None), (401, []), (402, [1.0, 2.0, 3.0]),
             (403, [1.0, None, 2.0, 3.0]), (404, [1.0, float("nan"), 0.0, 0.0]), (405, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "c", "i", "v", "d") for i, v in rows], VECTORS).repartition(3)
    got = clusters.cluster_vectors(df, dim=4, clusters=5, rounds=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    mine = sorted((tuple(x) for x in got.collect()), key=str)
    if scale < 1e15:  # sums of clamped distances differ beyond a long
        assert mine == plain_clusters(rows, 5, 3, 4)
    else:
        assert [x[:3] + x[5:] for x in mine] == [x[:3] + x[5:] for x in plain_clusters(rows, 5, 3, 4)]


def test_equal_distances_favour_the_smaller_number():
    game = clusters.Tournament([[0, 0], [2, 0], [2, 0], [0, 2]])
    near, apart = game.nearest(np.array([[1, 0], [2, 0], [1, 1], [0, 2]]))
    assert near.tolist() == [0, 1, 0, 3] and apart == [1, 0, 2, 0]


def test_few_vectors_and_none(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0], "", "", "", ""), (2, [5.0, 5.0], "", "", "", "")], VECTORS)
    assert sorted(r["distance"] for r in clusters.cluster_vectors(few, dim=2).collect()) == [0, 0]
    assert clusters.cluster_vectors(few.limit(0), dim=2).collect() == []
    huge = spark.createDataFrame([(1, [1e300, -1e308], "", "", "", ""), (2, [0.0, 0.0], "", "", "", "")], VECTORS)
    assert clusters.cluster_vectors(huge, dim=2, clusters=1, rounds=0).filter("distance = 9223372036854775807").count() in (1, 2)


# --- alignment ---------------------------------------------------------------
def plain_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = alignment._byte_level()
    placed = []
    for text in texts:
        a, b = [], []
        if text:
            code = a_model.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(code.ids, code.tokens)]
            for i in b_model.encode(text):
                p = b_model.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()))
            if any(b"".join(x for _, x in t) != (" " + text).encode() for t in (a, b)):
                a, b = [], []
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        placed.append(spans)
    links = []
    for a, b in placed:
        found, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                found.append((i, b[k][0]))
                k += 1
        links.append(found)
    n = Counter(x for found in links for x in found)
    most = defaultdict(int)
    for (_, b), c in n.items():
        most[b] = max(most[b], c)
    out = []
    for (a, b), found in zip(placed, links):
        ends, groups, last = sorted({e for *_, e in a} & {e for *_, e in b}), [], 0
        for end in ends:
            part = [",".join(str(i) for i, _, e in t if last < e <= end) for t in (a, b)]
            groups.append("|".join(part))
            last = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(ends), len(found), sum(n[x] == most[x[1]] for x in found), sum(n[x] for x in found), digest))
    return out


@pytest.mark.parametrize("block_bytes", [30, 12 << 20])
def test_alignment_equals_all_overlaps(spark, block_bytes):
    texts = [
        None, "", " ", "hello world", "hello world", "a<|endoftext|>b <s>x</s>", "x▁y", "日本語テキスト 🙂 naïve café", "  two  spaces \n\n tab\there ",
        "<0x41>", "aaaaaaaaaaaaaaaaaaaa bbbbbb", "\x00 nul", "é  nbsp　x", " ".join(prose(1, 400)), "internationalization " * 40, ".", ". dots",
    ]
    rows = spark.createDataFrame([(i, t, 1, "k", "c", "i", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = alignment.align_tokens(rows, block_bytes=block_bytes)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == dict(enumerate(plain_alignment(texts)))
    assert alignment.align_tokens(rows.limit(0)).collect() == []


def test_long_texts_are_cut_where_no_token_goes_on(monkeypatch):
    tool = alignment.Pieces()
    text = " ".join(prose(3, 3000)) + "  \n " + "日本 " * 500
    whole = tool.model.encode(text)
    monkeypatch.setattr(alignment, "PART_CHARS", 50)
    assert tool.encode([text, ""])[0].tolist() == whole


@given(st.lists(st.integers(0, 3000), max_size=300), st.lists(st.integers(0, 3000), max_size=300))
@settings(max_examples=200, deadline=None)
def test_galloping_finds_ranks(a, b):
    a, b = np.unique(np.array(a, np.int64)), np.unique(np.array(b, np.int64))
    assert (alignment.gallop(a, b) == np.searchsorted(b, a)).all()


def test_encoder_equals_plain_calls_on_odd_white_space_and_letters():
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from caseloom.llm import tokens

    path = tokens.vocabulary_path()
    library = Tokenizer.from_file(path)
    random.seed(7)
    letters = list("ab' \n\t\r,.<|>1²½éß×÷ɏɐ日\u0085 　​́\x1c\x00ªsl\U0001f642")
    texts = ["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "\n", "x" * 500 + " " + "y" * 60 + " z", "it's we'll I'd<|endoftext|> a", "It's 'tis can't 12²a"] * 2
    coder = tokens.Encoder(path)
    coder.remembered = 50
    for some in (texts[:1000], texts[1000:], texts[::-1]):
        assert coder.encode(some) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
