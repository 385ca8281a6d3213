"""Language identification by compression.

For each language the texts of a bounded sample form a raw-content zstandard
dictionary.  A text in lower case is encoded, in pieces, with every dictionary; the language
whose encoding is smallest wins.  ``accepted`` is false where the runner-up is
nearly as small; the prediction itself stays the best guess.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
not accepted; so is every text if no language can be learned; ties go to the
language first in order; rows with null id are predicted, never learned from;
repeated rows are predicted one by one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import in_fold, table

UNKNOWN = "und"


@dataclass(frozen=True)
class Dictionaries:
    """``bytes_per_language`` bounds each dictionary; of a sampled text at most ``longest`` characters go into it.

    Texts of any length are sampled, so a language of long texts alone is learned
    too.  Texts to predict are encoded in
    pieces of ``piece`` characters, so that the dictionary, not the text before,
    carries the decision; ``margin`` is the least relative distance to accept.
    """

    bytes_per_language: int = 112 << 10
    longest: int = 16 << 10
    piece: int = 2048
    level: int = 9
    margin: float = 0.02


def learn(documents: DataFrame, d: Dictionaries, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language, from a sample by hash whose expected size is twice the bound."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        "doc_id is not null and lang is not null and text is not null"
    ).filter(~in_fold("doc_id", 3, 1)).filter("text <> ''").withColumn("size", F.least(F.octet_length("text"), F.lit(d.longest)))
    sizes = {r["lang"]: r["sum(size)"] for r in rows.groupBy("lang").sum("size").collect()}  # a row per language
    if not sizes:
        return {}
    place = F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int((1 << 40) * min(1.0, 2 * d.bytes_per_language / n)))])
    out: dict[str, list[bytes]] = {lang: [] for lang in sorted(sizes)}
    for r in rows.filter(place < share[F.col("lang")]).select("lang", F.substring("text", 1, d.longest).alias("text"), place.alias("place")).orderBy("place", "text").collect():
        held = out[r["lang"]]
        if sum(map(len, held)) < d.bytes_per_language:
            held.append(r["text"].lower().encode())
    return {lang: b"\n".join(held)[: d.bytes_per_language] for lang, held in out.items() if held}


class Classifier:
    def __init__(self, contents: dict[str, bytes], d: Dictionaries):
        self.d, self.coders = d, []
        for lang in sorted(contents):
            content = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=d.level)
            self.coders.append((lang, zstandard.ZstdCompressor(level=d.level, dict_data=content, write_content_size=False, write_dict_id=False).compress))

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, score, accepted); the score is 0.5 for a tie and grows with the margin."""
        if not self.coders or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        text, step = text.lower(), self.d.piece
        pieces = [text[i : i + step].encode(errors="replace") for i in range(0, len(text), step)]
        sizes = sorted((sum(map(len, map(code, pieces))), lang) for lang, code in self.coders)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, True
        best, second = sizes[0], sizes[1]
        margin = (second[0] - best[0]) / second[0]
        return best[1], min(1.0, 0.5 + 2 * margin), margin >= self.d.margin


def predict(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Dictionaries = Dictionaries()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) per document."""
    contents = learn(documents, settings, id_col, text_col, lang_col)
    sent = documents.sparkSession.sparkContext.broadcast(contents)  # at most bytes_per_language each
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    @F.pandas_udf(kind)
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(sent.value, settings)
        for texts in batches:
            yield pd.DataFrame([classifier.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    found = documents.select(
        F.col(id_col).alias("doc_id"), in_fold(id_col, 3, 1).alias("held_out"), told(F.coalesce(F.col(text_col), F.lit(""))).alias("p")
    )
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.accepted")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
