"""Base spans against their plain patterns, long runs, and languages against a loop over plain compressors."""

import hashlib
import random
import re
import time
import zlib

import zstandard
from caseloom.llm import language, pii

PLAIN_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in PLAIN_IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c not in " -"]
        odd, even = d[-1::-2], d[-2::-2]
        if 16 <= len(d) <= 19 and (sum(odd) + sum(sum(divmod(2 * x, 10)) for x in even)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.findall("[0-9]", m.group())) <= 15]
    return out


def test_base_spans_equal_their_patterns():
    r = random.Random(7)
    parts = ["1", "2", "03", "255", "256", "000", ".", ".", "..", " ", "-", "+1", "(", ")", "a", "@x.y", "4111 1111 1111 1111", "5500-0000-0000-0004", "+49 30 1234567", "٣"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(24)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_end_soon(spark):
    zeros = "0" * 5000 + ".1.1.1"
    assert pii.base_spans(zeros) == [("ip", 0, 5006)]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []
    start = time.time()
    for text in ("7" * 1_000_000, "1." * 500_000, "+1(" * 300_000, "1 " * 500_000, "@" * 1_000_000, "a" * 1_000_000 + "@"):
        pii.base_spans(text)
    assert time.time() - start < 20
    rows = spark.createDataFrame([(1, zeros), (2, "5" * 1_000_000), (3, None)], "doc_id long, text string")
    assert {x["doc_id"]: x["n_ip"] for x in pii.find(rows).collect()} == {1: 1, 2: 0, 3: 0}


def test_a_language_of_long_texts_is_learned(spark):
    r = random.Random(3)
    kinds = {"short": "the of and water stone river".split(), "long": "der und wasser stein fluss nicht".split()}
    rows = [(i, " ".join(r.choice(kinds[k]) for _ in range(4000 if k == "long" else 30)), k) for i, k in enumerate(["short", "long"] * 60)]
    got = {x["doc_id"]: x["lang_pred"] for x in language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i: k for i, _, k in rows}


def test_predictions_equal_a_loop_over_plain_compressors(spark):
    r = random.Random(8)
    vocab = {k: ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(60)] for k in ("x", "y", "z")}
    rows = [(i, " ".join(r.choice(vocab[k]) for _ in range(r.randrange(1, 50))), k) for i, k in enumerate(["x", "y", "z"] * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d = language.Dictionaries()
    contents = language.learn(df, d)
    trained = {lang: sorted(t.lower() for i, t, k in rows if k == lang and zlib.crc32(str(i).encode()) % 3 != 1) for lang in "xyz"}
    assert {lang: sorted(c.decode().split("\n")) for lang, c in contents.items()} == trained  # all fit their bound here
    for x in language.predict(df).collect():
        text = next(t for i, t, _ in rows if i == x["doc_id"])
        sizes = {}
        for lang in sorted(contents):
            data = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=d.level, dict_data=data, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(text.lower()[i : i + d.piece].encode())) for i in range(0, len(text), d.piece))
        best = min(sizes, key=lambda k: (sizes[k], k))
        second = min(v for k, v in sizes.items() if k != best)
        assert x["lang_pred"] == best and abs(x["score"] - min(1, 0.5 + 2 * (second - sizes[best]) / second)) < 1e-12


def test_digest_of_base_spans():
    text = "mail a@b.co from 10.0.0.1"
    assert pii.base_digest(text) == hashlib.sha256(b"email:5:11,ip:17:25").hexdigest()
