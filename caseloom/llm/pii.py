"""Personal data by weak supervision.

Base spans (e-mail, ip, card, phone) come from fixed patterns and always stay.
Further spans are candidates: words with digits outside the base spans.  Eight
labelers vote on each for, against or not at all: two patterns, three
gazetteers of neighbouring words, two shapes and the assignment context.  Votes
and features take few values, so the whole corpus reduces to a bounded table of
counts.  On it, expectation-maximisation estimates each labeler's reliability
and the posterior of every vote pattern, and a logistic regression trained on
those posteriors over all counts is the final classifier of spans.

Defined cases: a null or empty text has no spans; repeated rows are judged one
by one; other columns are left out of ``find``; without candidates nothing but
base spans is returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import land, table

# The kinds in their order, and the base patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "number")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches in linear time: an address starts where a run of digits does, and runs are never given back.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Words before a candidate that speak for a secret or a personal number, against, and units after it.
SECRET_WORDS = {"token", "key", "secret", "password", "passwd", "pwd", "apikey", "api_key", "auth", "bearer", "access_token", "credential"}
PERSONAL_WORDS = {"ssn", "iban", "account", "passport", "id", "tel", "phone", "mobile", "fax", "licence", "license", "konto", "ausweis", "compte", "cuenta"}
PLAIN_WORDS = {"page", "version", "chapter", "figure", "table", "year", "no", "vol", "section", "seite", "kapitel", "chapitre", "capítulo"}
UNITS = {"%", "kg", "km", "m", "cm", "eur", "usd", "€", "$", "gb", "mb", "years", "jahre", "ans", "años", "people"}
LABELERS = 8

_DIGIT = re.compile(r"[0-9]\S*")
_HEX = re.compile(r"[0-9A-Fa-f]{16,}")
_GROUPED = re.compile(r"[0-9]{2,}(?:[-./][0-9]{2,})+")
_EDGE = "\"'()[]{}<>,;:.!?*&%$#`=|"
SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("key", T.StringType()),
]))


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As ``EMAIL.finditer``: a match holds one at sign after the longest run before it, so only those are tried."""
    out, pos, local = [], 0, "._%+-"
    at = text.find("@")
    while at >= 0:
        start = at
        while start > pos and (text[start - 1] in local or text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            pos = m.end()
        else:
            pos = max(pos, start)
        at = text.find("@", max(at + 1, pos))
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", s, e) for s, e in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return found


def _word_before(text: str, at: int) -> tuple[str, bool]:
    """(the last word before ``at``, whether an assignment mark stands between)."""
    i, assigned = at, False
    while i > 0 and (text[i - 1].isspace() or text[i - 1] in "\"'=:(["):
        assigned |= text[i - 1] in "=:"
        i -= 1
    j = i
    while j > 0 and (text[j - 1].isalnum() or text[j - 1] == "_"):
        j -= 1
    return text[j:i].lower(), assigned


def _level(value: float, steps: tuple) -> int:
    return sum(value >= s for s in steps)


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, key) of the words with digits outside ``taken``; the key holds votes and features."""
    out, spans, k = [], sorted((s, e) for _, s, e in taken), 0
    reach = 0
    for m in _DIGIT.finditer(text):
        s, e = m.span()
        while s > reach and not text[s - 1].isspace():
            s -= 1
        reach = e
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        if e - s < 4 or any(a < e for a, _ in spans[k : k + 1]):
            continue
        word = text[s:e]
        digits = sum(c.isdigit() for c in word)
        letters = sum(c.isalpha() for c in word)
        variety = len(set(word))
        before, assigned = _word_before(text, s)
        after = text[e : e + 12].split(None, 1)
        unit = bool(after) and after[0].lower().strip(".,;") in UNITS
        hexa = bool(_HEX.fullmatch(word)) and letters > 0
        grouped = digits >= 7 and bool(_GROUPED.fullmatch(word))
        votes = (
            hexa, grouped, 1 if before in SECRET_WORDS else 0, 1 if before in PERSONAL_WORDS else 0,
            -1 if before in PLAIN_WORDS or unit else 0, -1 if not letters and digits <= 6 else 0,
            1 if len(word) >= 20 and letters and variety >= 8 else -1 if len(word) < 8 else 0, 1 if assigned else 0,
        )
        features = (
            _level(len(word), (6, 8, 12, 20, 32)), _level(digits / len(word), (0.25, 0.5, 0.75, 1)), _level(variety, (4, 8, 12)),
            int(letters > 0), int(hexa), int(grouped), int(before in SECRET_WORDS or before in PERSONAL_WORDS), int(assigned),
            int(unit or before in PLAIN_WORDS),
        )
        key = "".join("-0+"[int(v) + 1] for v in votes) + ":" + "".join(map(str, features))
        out.append(("secret" if letters else "number", s, e, key))
    return out


def reliabilities(votes: np.ndarray, counts: np.ndarray, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation: (posterior per row, P(vote | class) per labeler, prior).

    ``votes`` are 0, 1, 2 for against, none, for.  Starts from the majority and
    ends when no posterior moves by more than ``tolerance``.
    """
    score = (votes - 1).sum(axis=1)
    post = 1 / (1 + np.exp(-1.5 * score + 0.5))
    while True:
        prior = float(np.clip((post * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        table_ = np.ones((2, votes.shape[1], 3))
        for y, weight in ((0, counts * (1 - post)), (1, counts * post)):
            for j in range(votes.shape[1]):
                table_[y, j] += np.bincount(votes[:, j], weights=weight, minlength=3)
        table_ /= table_.sum(axis=2, keepdims=True)
        each = np.arange(votes.shape[1])
        gap = (np.log(table_[1, each, votes]) - np.log(table_[0, each, votes])).sum(axis=1) + np.log(prior / (1 - prior))
        now = 1 / (1 + np.exp(-np.clip(gap, -40, 40)))
        if np.abs(now - post).max() <= tolerance:
            return now, table_, prior
        post = now


def fit_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression on soft targets by Newton's method."""
    x = np.hstack([features, np.ones((len(features), 1))])
    weight, w = counts / counts.sum(), np.zeros(x.shape[1])
    while True:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + ridge * 1e-2 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            return w


def _one_hot(keys: list[str]) -> np.ndarray:
    levels = (6, 5, 4, 2, 2, 2, 2, 2, 2)
    values = np.array([[int(c) for c in k.split(":")[1]] for k in keys])
    return np.hstack([(values[:, [j]] == np.arange(n)).astype(float) for j, n in enumerate(levels)])


def learn(counted: dict[str, int], threshold: float = 0.5) -> set[str]:
    """The keys that the trained classifier accepts."""
    if not counted:
        return set()
    keys = sorted(counted)
    counts = np.array([counted[k] for k in keys], float)
    votes = np.array([["-0+".index(c) for c in k.split(":")[0]] for k in keys])
    post, _, _ = reliabilities(votes, counts)
    x = _one_hot(keys)
    w = fit_classifier(x, post, counts)
    score = 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ w, -30, 30)))
    return {k for k, s in zip(keys, score) if s >= threshold}


@F.pandas_udf(SPAN)
def _marked(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        base = base_spans(t)
        out.append([
            {"kind": k, "start": s, "end": e, "key": key}
            for k, s, e, key in [(*b, "") for b in base] + candidates(t, base)
        ])
    return pd.Series(out)


def accepted_keys(marked: DataFrame) -> set[str]:
    """What the classifier accepts, from the counts of all candidates; their table is bounded by the key's values."""
    rows = marked.select(F.explode("marks.key").alias("key")).filter("key <> ''").groupBy("key").count().collect()
    return learn({r["key"]: r["count"] for r in rows})


def chosen(marks: Column, keys: set[str]) -> Column:
    return F.filter(marks, lambda m: m["key"].isin("", *sorted(keys)))


def listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(BASE_KINDS + ADDED_KINDS) for x in (k, i)])
    ranked = F.array_sort(F.transform(spans, lambda m: F.struct(order[m["kind"]].alias("o"), m["start"].alias("s"), m["end"].alias("e"), m["kind"].alias("k"))))
    return F.array_join(F.transform(ranked, lambda m: F.concat_ws(":", m["k"], m["s"], m["e"])), ",")


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    marked = land(documents.select(F.col(id_col).alias("doc_id"), _marked(F.coalesce(F.col(text_col), F.lit(""))).alias("marks")), "marks")
    keys = accepted_keys(marked)
    base = F.filter("marks", lambda m: m["key"] == "")
    count = lambda kind: F.size(F.filter("marks", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return marked.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(chosen(F.col("marks"), keys)).alias("spans"),
    )


def redact(documents: DataFrame) -> DataFrame:
    """All documents and columns, every span in ``text`` replaced by its kind in capitals."""
    marks = _marked(F.coalesce("text", F.lit("")))
    marked = land(documents.select(F.struct("*").alias("d"), marks.alias("marks")), "marks")
    keys = accepted_keys(marked)

    @F.pandas_udf(T.StringType())
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans):
            if text is None or not len(found):
                out.append(text)
                continue
            parts, at = [], 0
            for m in sorted(found, key=lambda m: (m["start"], -m["end"])):
                if m["start"] >= at:
                    parts += [text[at : m["start"]], f"[{m['kind'].upper()}]"]
                at = max(at, m["end"])
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    new = marked.select("d", masked(F.col("d.text"), chosen(F.col("marks"), keys)).alias("masked"))
    size = F.when(F.col("masked") == F.col("d.text"), F.col("d")["n_chars"]).otherwise(F.length("masked").cast("long")) if "n_chars" in documents.columns else None
    return new.select(*[
        F.col("masked").alias("text") if c == "text" else size.alias(c) if c == "n_chars" else F.col("d")[c].alias(c) for c in documents.columns
    ])


def base_digest(text: str | None) -> str:
    """Plain form of ``base_sha256``, for tests."""
    spans = sorted((BASE_KINDS.index(k), s, e) for k, s, e in base_spans(text or ""))
    return hashlib.sha256(",".join(f"{BASE_KINDS[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
