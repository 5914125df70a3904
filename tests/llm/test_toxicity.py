import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.toxicity import (
    Scan,
    fit_logistic,
    karlin_lambda,
    maximal_segments,
    op8_toxicity,
    score_toxicity,
    token_scores,
    with_segments,
)

FOLDER = "/root/testdata/sf0.01"


def by_hand(scores):
    """The best-scoring run first, then the same on both sides of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = sum(scores[i:j])
            if total > 0 and (best is None or total > best[0]):
                best = (total, i, j)
    if best is None:
        return []
    _, i, j = best
    left = by_hand(scores[:i])
    right = [(s, a + j, b + j) for s, a, b in by_hand(scores[j:])]
    return [*left, best, *right]


def test_segments_as_by_hand():
    rng = random.Random(2)
    for n in (0, 1, 2, 5, 9, 17, 30):
        for _ in range(30):
            scores = [rng.choice([-1, 1]) * (rng.random() + 2.0 ** -rng.randint(1, 30)) for _ in range(n)]
            got = [(round(s, 9), a, b) for s, a, b in maximal_segments(np.array(scores))]
            assert got == [(round(s, 9), a, b) for s, a, b in by_hand(scores)]


def test_lambda_is_the_root():
    scores, share = np.array([2.0, -1.0, 0.5]), np.array([1.0, 8.0, 1.0])
    rate = karlin_lambda(scores, share)
    assert (share / share.sum()) @ np.exp(rate * scores) == pytest.approx(1)
    assert karlin_lambda(np.array([-1.0]), np.array([3.0])) == 1.0


def test_logistic_meets_its_margins():
    rows = [(-2.0, 100, 5), (0.0, 80, 20), (3.0, 40, 36)]
    a, b = fit_logistic(rows)
    expected = sum(n / (1 + np.exp(-(a + b * x))) for x, n, _ in rows)
    assert expected == pytest.approx(61, abs=0.1) and b > 0
    assert fit_logistic([]) == (0.0, 0.0)


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic")
    got = op8_toxicity(spark, FOLDER).join(labels, "doc_id", "left").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    known = got[got["held_out"] & got["toxic"].notna()]
    rank = known["score"].rank()
    pos = known["toxic"] == 1
    area = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert pos.sum() >= 3 and area > 0.8


def test_passages_and_edges(spark, documents, clashing, empty):
    scores = token_scores(np.zeros((2, 1 << 18)))
    assert (scores < 0).all()
    bad = spark.createDataFrame(
        [(1000 + i, f"good day here my friend number {i} " + ("you vile rotten thing " if i % 3 == 0 else "") + "and so on", None, None, 1) for i in range(300)],
        documents.schema,
    )
    every = documents.unionByName(bad)
    labels = bad.select("doc_id", F.when(F.col("doc_id") % 3 == 1, 1).otherwise(0).alias("toxic"))
    got = {(r["doc_id"], r["text"]): r for r in score_toxicity(every, labels).join(every.select("doc_id", "text"), "doc_id").collect()}
    for (doc, text), row in got.items():
        if doc is not None and doc >= 1000:
            assert row["predicted"] == int(doc % 3 == 1)
            if doc % 3 == 1:
                first = max(row["passages"], key=lambda p: p["score"])
                assert "vile rotten" in text[first["start"] : first["end"]]
        elif doc in (120, 121):
            assert row["predicted"] == 0 and row["n_tokens"] == 0 and row["passages"] == []
    assert score_toxicity(clashing, labels).count() == documents.count()
    assert score_toxicity(empty, labels).count() == 0
    none = score_toxicity(documents, labels.where("false"))
    assert none.where("score <> 0.5").count() == 0


def test_offsets_are_characters(spark):
    scores = np.full(1 << 18, 1.0)
    df = spark.createDataFrame([(1, "  é日 ab, c! ")], "id int, text string")
    row = with_segments(df, Scan(scores, 1.0)).first()
    (segment,) = row["segments"]
    assert row["n_tokens"] == 3 and "  é日 ab, c! "[segment["start"] : segment["end"]] == "é日 ab, c!"


def test_all_maximal_segments_of_a_long_text_are_kept(spark):
    """A cut by a constant before the fit lost those that only a small log_k makes significant."""
    from tidemark.llm.toxicity import _cells
    from tidemark.llm.wordhash import LETTERS, word_runs

    text = " ".join(["bäd bäd"] * 3 + ["day"] * 5000 + ["bäd"] + ["day"] * 5000 + ["bäd bäd"])
    import pyarrow as pa

    (_, words), = word_runs(pa.array(["bäd"]), LETTERS)
    scores = np.full(1 << 18, -1.0)
    scores[_cells(words.hashes)] = 1.0
    row = with_segments(spark.createDataFrame([(1, text)], "id int, text string"), Scan(scores, 1.0)).first()
    assert [s["score"] for s in row["segments"]] == [6.0, 2.0, 1.0]
    assert {text[s["start"] : s["end"]] for s in row["segments"]} == {"bäd bäd bäd bäd bäd bäd", "bäd bäd", "bäd"}
