"""Language identification by compression.

For every language a raw-content dictionary is made of a bounded sample of its
labelled texts.  A text is cut into windows, each is compressed with every
language's dictionary by zstandard, and the language of the smallest total is
chosen; a narrow margin to the next one is a rejection.  How common a language is
among the labelled rows counts too, which decides for the shortest texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import document_table, fold, fresh

#: The fit's bounds: sampled texts of each language, and characters of each in so many pieces.
SAMPLES, SAMPLE_CHARS, PIECES = 64, 768, 3
#: Characters compressed at once, and the compression level.
WINDOW, LEVEL = 1024, 7
#: Bytes by which a language must be larger to be e times less likely.
BYTES_PER_NAT = 6.0
#: Scores below this are rejected: the best language is not clearly likelier than the next.
MIN_SCORE = 0.55
UNKNOWN = "und"

RESULT = "lang_pred string, score double, rejected boolean"


@dataclass(frozen=True)
class Model:
    """Dictionary and share of the labelled rows of every language."""

    dictionaries: Mapping[str, bytes]
    shares: Mapping[str, float]


def spread_pieces(text: Column, chars: int, pieces: int = PIECES) -> Column:
    """Pieces of a text, ``chars`` characters together, from places that its hash chooses all over it.

    A text of no more characters is taken whole.
    """
    each = max(1, (chars - pieces + 1) // pieces)
    starts = F.char_length(text) - each + 1
    parts = [
        F.substring(text, (F.lit(1) + F.pmod(F.xxhash64(text, F.lit(i)), starts)).cast("int"), F.lit(each))
        for i in range(pieces)
    ]
    return F.when(F.char_length(text) <= chars, text).otherwise(F.concat_ws("\n", *parts))


def fit_model(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    samples: int = SAMPLES,
    sample_chars: int = SAMPLE_CHARS,
) -> Model:
    """Dictionaries and shares of the languages in ``labelled``.

    Of each language up to ``samples`` texts are taken, the one of least hash in
    each of as many hash ranges, and up to ``sample_chars`` characters of each,
    in pieces from all over it: at most ``samples * sample_chars`` characters a
    language reach the driver, whatever the size of the table.  Shares count all
    rows.  Rows without language, and texts without a letter, are passed over.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")
    )
    rows = rows.withColumn("part", F.pmod("hash", F.lit(samples)).cast("int"))
    least = rows.groupBy("lang", "part").agg(F.min("hash").alias("hash"), F.count(F.lit(1)).alias("n"))
    picked = (
        rows.join(F.broadcast(least), ["lang", "part", "hash"])
        .groupBy("lang", "part")
        .agg(F.min(spread_pieces(F.col("text"), sample_chars)).alias("text"), F.first("n").alias("n"))
    )
    found: dict[str, list[tuple[int, str]]] = {}
    counts: dict[str, int] = {}
    for row in picked.collect():
        found.setdefault(row["lang"], []).append((row["part"], row["text"]))
        counts[row["lang"]] = counts.get(row["lang"], 0) + row["n"]
    content = {name: "\n".join(t for _, t in sorted(found[name])).lower().encode() for name in sorted(found)}
    return Model(content, {name: n / sum(counts.values()) for name, n in counts.items()})


class Compressors:
    """The languages' compressors; not thread-safe, one for each Python worker."""

    def __init__(self, model: Model, level: int = LEVEL):
        self.languages = sorted(model.dictionaries)
        self.shares = [model.shares[name] for name in self.languages]
        self.compress = []
        for name in self.languages:
            content = zstandard.ZstdCompressionDict(
                model.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            content.precompute_compress(level=level)
            compressor = zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False)
            self.compress.append(compressor.compress)

    def sizes(self, text: str, window: int = WINDOW) -> list[int]:
        """Compressed bytes of the whole text under each language, window by window."""
        text = text.lower()
        parts = [text[i : i + window].encode() for i in range(0, len(text), window)]
        return [sum(len(compress(part)) for part in parts) for compress in self.compress]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected.

        The language with the smallest size is taken, among equals the commoner
        one, then the first by name.  In the score, its part of the sum, a
        language counts by how common it is, and ``e`` times less for
        ``BYTES_PER_NAT`` bytes more; so a narrow margin has a low score.
        """
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        least = min(sizes)
        weights = [s * math.exp((least - size) / BYTES_PER_NAT) for s, size in zip(self.shares, sizes)]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], -self.shares[i], self.languages[i]))
        score = weights[best] / sum(weights)
        return self.languages[best], score, score < MIN_SCORE


def with_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``; columns of these names are replaced.

    A null text and one without a letter are ``und`` with score 0 and rejected.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = Compressors(shared.value)
        for batch in batches:
            found = [compressors.classify(t) for t in batch]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "rejected"])

    rows = df.drop("lang_pred", "score", "rejected")
    (result,) = fresh(rows, "language")
    return rows.withColumn(result, classify(F.col(text))).select(
        *rows.columns, *[F.col(result)[c].alias(c) for c in ("lang_pred", "score", "rejected")]
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 3) == 1, F.lit(False))


def document_model(documents: DataFrame) -> Model:
    return fit_model(documents.where(~held_out(F.col("doc_id"))))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    documents = document_table(spark, folder)
    return with_language(documents.select("doc_id", "text"), document_model(documents)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )
