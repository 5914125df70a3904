"""Toxicity by maximum-scoring segments.

Tokens get log-odds between toxic and other labelled documents under a Dirichlet
prior, shrunk towards zero by two standard errors and lowered by a drift, so
that an ordinary text scores below zero.  A linear scan finds all maximal
scoring segments of a text.  Under Karlin-Altschul statistics a segment of score
S among n tokens is expected ``K n exp(-lambda S)`` times by chance; the
evidence of a document adds the logarithms of its segments' rarity, and a
logistic curve over it gives the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import document_table, fold, fresh, written
from tidemark.llm.wordhash import LETTERS, word_runs

#: Tokens are hashed into this many cells; counts and scores are arrays of this size.
CELLS = 1 << 18
#: About as many labelled rows at most teach the token scores; they are broadcast.
LABELLED_ROWS = 250_000
PRIOR, PRIOR_TOKENS = 0.25, 2_000.0
STANDARD_ERRORS, DRIFT = 2.0, 0.1
EULER = 0.5772156649015329
BINS, LOWEST, HIGHEST = 460, -6.0, 40.0


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def class_counts(labelled: DataFrame, text: str = "text", toxic: str = "toxic") -> np.ndarray:
    """Documents of either class that hold a cell's token: an array ``[2, CELLS]``.

    Each task sends one row per cell it has met, and these are summed before
    the array, of fixed size, reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CELLS), dtype=np.int64)
        for batch in batches:
            label = np.asarray(batch.column(1).to_pylist(), dtype=np.int64)
            for low, words in word_runs(batch.column(0), LETTERS):
                once = np.unique(words.text * CELLS + _cells(words.hashes))
                kind = label[low + once // CELLS]
                for which in (0, 1):
                    counts[which] += np.bincount(once[kind == which] % CELLS, minlength=CELLS)
        met = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(counts[0, met]), pa.array(counts[1, met])], ["cell", "other", "toxic"]
        )

    rows = labelled.select(F.col(text).alias("text"), F.col(toxic).cast("int").alias("toxic"))
    summed = (
        rows.mapInArrow(count, "cell bigint, other bigint, toxic bigint")
        .groupBy("cell")
        .agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
        .toPandas()
    )
    counts = np.zeros((2, CELLS))
    counts[0, summed["cell"]] = summed["other"]
    counts[1, summed["cell"]] = summed["toxic"]
    return counts


def token_scores(counts: np.ndarray) -> np.ndarray:
    """Shrunk log-odds of every cell less the drift.

    The prior spreads ``PRIOR_TOKENS`` over the cells by their overall share
    and adds ``PRIOR`` to each.
    """
    both = counts.sum(axis=0)
    prior = PRIOR + PRIOR_TOKENS * both / max(1.0, both.sum())
    other, toxic = counts[0] + prior, counts[1] + prior
    odds = np.log(toxic / (toxic.sum() - toxic)) - np.log(other / (other.sum() - other))
    error = np.sqrt(1 / toxic + 1 / other)
    return np.sign(odds) * np.maximum(np.abs(odds) - STANDARD_ERRORS * error, 0) - DRIFT


def karlin_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of ``sum(p * exp(lambda * s)) = 1`` for token shares ``p``."""
    if not weights.sum() or scores[weights > 0].max() <= 0:
        return 1.0
    share = weights / weights.sum()

    def over(rate: float) -> bool:
        return float(share @ np.exp(np.minimum(rate * scores, 700))) > 1

    low, high = 1e-6, 1e-3
    while not over(high) and high < 1e3:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if over(middle) else (middle, high)
    return high


def maximal_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, first, last + 1)``, in linear time.

    Each positive token opens a segment.  It is joined with the nearest earlier
    one that starts lower, if it also ends higher than that one, and so on.
    """
    total = np.cumsum(scores)
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    lower: list[int] = []  # nearest earlier segment that starts lower
    for i in np.flatnonzero(scores > 0).tolist():
        after = float(total[i])
        before, first = after - float(scores[i]), i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= before:
                j = lower[j]
            if j < 0 or found[j][1] >= after:
                break
            before, first = found[j][0], found[j][2]
            del found[j:], lower[j:]
        found.append((before, after, first, i + 1))
        lower.append(j)
    return [(after - before, first, end) for before, after, first, end in found]


@dataclass(frozen=True)
class Scan:
    scores: np.ndarray
    rate: float


def with_segments(df: DataFrame, scan: Scan, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``segments`` of ``(score, start, end)``, best first.

    ``start`` and ``end`` are characters of the text.  Listed are all maximal
    segments, since which are significant is known only after ``log_k`` is
    fitted to them.  A null or empty text has no token and no segment.
    """
    shared = df.sparkSession.sparkContext.broadcast(scan)
    kind = pa.struct(
        [
            ("n_tokens", pa.int64()),
            ("segments", pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )

    @F.arrow_udf("n_tokens bigint, segments array<struct<score:double,start:int,end:int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = shared.value.scores
        for batch in batches:
            out = []
            for low, words in word_runs(batch, LETTERS):
                value = scores[_cells(words.hashes)]
                bounds = words.bounds().tolist()
                for text in range(words.texts):
                    a, b = bounds[text], bounds[text + 1]
                    found = sorted(maximal_segments(value[a:b]), reverse=True) if b > a else []
                    segments = []
                    if found:
                        raw = batch[low + text].as_py().encode()
                        start = words.starts[a:b] - words.offsets[text]
                        lead = np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80
                        before = np.concatenate([[0], np.cumsum(lead)])
                        for score, first, end in found:
                            until = int(start[end]) if end < b - a else len(raw)
                            at = int(before[start[first]])
                            passage = raw[int(start[first]) : until].decode().rstrip()
                            segments.append({"score": score, "start": at, "end": at + len(passage)})
                    out.append({"n_tokens": b - a, "segments": segments})
            yield pa.array(out, kind)

    rows = df.drop("n_tokens", "segments")
    (result,) = fresh(rows, "scan")
    return rows.withColumn(result, find(F.col(text))).select(
        *rows.columns, F.col(result)["n_tokens"].alias("n_tokens"), F.col(result)["segments"].alias("segments")
    )


def rarity(score: Column, tokens: Column, rate: float, log_k: float) -> Column:
    """Minus the logarithm of a segment's expected number among so many tokens."""
    return rate * score - F.log(F.greatest(tokens, F.lit(1)).cast("double")) - log_k


def evidence(rate: float, log_k: float) -> Column:
    """Sum of the positive rarities of a document's segments, else its best one's.

    It is kept between ``LOWEST`` and ``HIGHEST``; a text without a segment,
    such as an empty one, has the lowest.
    """
    tokens = F.col("n_tokens")
    best = F.get("segments", F.lit(0))["score"]
    more = F.aggregate(
        "segments",
        F.lit(0.0),
        lambda total, s: total + F.greatest(rarity(s["score"], tokens, rate, log_k), F.lit(0.0)),
    )
    value = F.when(more > 0, more).otherwise(F.coalesce(rarity(best, tokens, rate, log_k), F.lit(LOWEST)))
    return F.least(F.greatest(value, F.lit(LOWEST)), F.lit(HIGHEST))


def fit_logistic(binned: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope by Newton's method over ``(x, rows, positive rows)``, lightly penalised."""
    if not binned:
        return 0.0, 0.0
    x, n, y = (np.array(column, dtype=float) for column in zip(*binned))
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    penalty = np.array([1e-6, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - n * p) - penalty * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score_toxicity(
    documents: DataFrame, labelled: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic"
) -> DataFrame:
    """``documents`` with ``n_tokens``, ``passages``, ``score`` and ``predicted``.

    ``labelled`` has ``doc_id`` and ``toxic`` (1 or 0; others are passed over)
    of the documents to learn from.  The token scores come from ``LABELLED_ROWS``
    of them, drawn by hash, or all if there are fewer; significance and the
    logistic curve come from all.  ``passages`` are the significant segments:
    ``(score, start, end, expected)`` with fewer than one expected by chance.
    Columns of these names are replaced.  Without labels every score is 0.5.
    """
    labels = labelled.where(F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("label_doc"), F.col(toxic).alias("label")
    )
    texts = documents.select(F.col(doc_id).alias("label_doc"), F.col(text).alias("text"))
    step = max(1, -(-labels.count() // LABELLED_ROWS))
    teachers = labels.where(F.pmod(F.xxhash64("label_doc"), F.lit(step)) == 0)
    counts = class_counts(texts.join(F.broadcast(teachers), "label_doc"), "text", "label")
    scores = token_scores(counts)
    rate = karlin_lambda(scores, counts[0])
    rows = documents.drop("n_tokens", "segments", "passages", "score", "predicted")
    # everything but the text is kept; the text is scanned once
    scanned = written(with_segments(rows, Scan(scores, rate), text).drop(text), "segments")
    known = scanned.join(labels, scanned[doc_id] == labels["label_doc"])
    best = F.get("segments", F.lit(0))["score"]
    mean = known.where("label = 0").agg(F.avg(rarity(best, F.col("n_tokens"), rate, 0.0))).first()[0]
    log_k = (mean or 0.0) - EULER
    width = (HIGHEST - LOWEST) / BINS
    place = F.floor((evidence(rate, log_k) - LOWEST) / width)
    binned = known.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).collect()
    intercept, slope = fit_logistic([(LOWEST + (r["bin"] + 0.5) * width, r["n"], r["y"]) for r in binned])
    score = 1 / (1 + F.exp(-(intercept + slope * evidence(rate, log_k))))
    passages = F.filter(
        F.transform(
            "segments",
            lambda s: F.struct(
                s["score"].alias("score"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.exp(-rarity(s["score"], F.col("n_tokens"), rate, log_k)).alias("expected"),
            ),
        ),
        lambda p: p["expected"] < 1,
    )
    return (
        scanned.withColumn("score", score)
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        .withColumn("passages", passages)
        .drop("segments")
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(False))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out(F.col("doc_id")))
    documents = document_table(spark, folder).select("doc_id", "text")
    return score_toxicity(documents, labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passages"
    )
