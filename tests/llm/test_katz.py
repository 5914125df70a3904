import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm.katz import (
    RESULTS, good_turing, katz_scores, op12_katz, packed, packed_keys, unpacked, unpacked_keys,
)

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, START, UNKNOWN = ("end",), ("start",), ("unknown",)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


class ByHand:
    """The model in dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order)]
        for text in texts:
            tokens = [START] * (order - 1) + words_of(text) + [END]
            for i in range(order - 1, len(tokens)):
                for n in range(order):
                    self.counts[n][tuple(tokens[i - n : i + 1])] += 1
        self.factors = []
        for c in self.counts:
            times = Counter(c.values())
            self.factors.append(good_turing(np.array([times[r] for r in range(1, 7)])))
        self.n, self.v = sum(self.counts[0].values()), len(self.counts[0])
        freed = sum(c - self.discounted(0, c) for c in self.counts[0].values())
        self.words = self.n + (freed <= 1e-12)
        self.unknown = (freed if freed > 1e-12 else 1) / self.words
        self.context = {}
        for n in range(1, order):
            for gram, c in self.counts[n].items():
                entry = self.context.setdefault(gram[:-1], [0, 0.0, 0.0])
                entry[0] += c
                entry[1] += c - self.discounted(n, c) if c <= 5 else 0
                entry[2] += self.p(gram[1:])

    def discounted(self, n, c):
        return c * self.factors[n][c - 1] if c <= 5 else c

    def p(self, gram):
        n = len(gram) - 1
        c = self.counts[n][gram]
        if n == 0:
            return self.discounted(0, c) / self.words if c else self.unknown
        total, freed, shorter = self.context.get(gram[:-1], (0, 0, 0))
        if not total:
            return self.p(gram[1:])
        divisor, freed = (total, freed) if freed > 0 else (total + 1, 1)
        if c:
            return self.discounted(n, c) / divisor
        return freed / divisor / (1 - shorter) * self.p(gram[1:])

    def result(self, text):
        tokens = [START] * (self.order - 1) + words_of(text) + [END]
        real = tokens[self.order - 1 :]
        single = [self.counts[0][(t,)] for t in real]
        base = sum(math.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1))) for c in single)
        score = sum(math.log10(self.p(tuple(tokens[i : i + self.order]))) for i in range(len(real)))
        return len(real), sum(c > 0 for c in single), self.n, base, score


def sentences(n, seed, words=60):
    rng = random.Random(seed)
    known = [f"{'Ww'[i % 2]}{i}é" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [" ".join(rng.choices(known, weights, k=rng.randint(0, 40))) + rng.choice(["", " ", "\t"]) for _ in range(n)]


def same(got, want):
    assert tuple(got[c] for c in RESULTS[:3]) == want[:3]
    assert got["base_score"] == pytest.approx(want[3], rel=1e-9, abs=1e-9)
    assert got["score"] == pytest.approx(want[4], rel=1e-9, abs=1e-9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, (1 << 63) - 1), max_size=40))
def test_numbers_as_bytes(values):
    numbers = np.array(values, np.int64)
    assert unpacked(packed(numbers)).tolist() == values
    keys = np.unique(np.array([v * 2 + 1 for v in values], np.uint64))
    low = int(keys[0]) if len(keys) else 0
    for base in {0, low}:
        assert unpacked_keys(packed_keys(keys, base), base).tolist() == keys.tolist()


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block_tokens", [300, 1 << 20])
def test_against_dictionaries(spark, order, block_tokens):
    texts = sentences(120, 3) + [None, "", "  \n", "newer words only", "w1é " * 900, "W1é"] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = katz_scores(df, F.col("doc_id") % 4 != 1, order=order, block_tokens=block_tokens, partition_tokens=500).collect()
    model = ByHand([t for i, t in enumerate(texts) if i % 4 != 1], order)
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for r in got:
        same(r, model.result(texts[r["doc_id"]]))


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_add_up(spark, order):
    texts = sentences(60, 5, 20)
    model = ByHand(texts, order)
    vocabulary = [g[0] for g in model.counts[0]] + [UNKNOWN]
    contexts = list(model.context) + [(UNKNOWN,) * (order - 1)]
    for context in contexts:
        if len(context) == order - 1:
            assert sum(model.p((*context, w)) for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_context_without_discounted_ngram(spark):
    texts = ["a b"] * 9 + ["c d e", "f", "g h", "a x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    model = ByHand(texts[:9] + texts[9:12], 2)
    for r in katz_scores(df, F.col("doc_id") < 12).collect():
        same(r, model.result(texts[r["doc_id"]]))
        assert math.isfinite(r["score"])


@pytest.mark.parametrize("times", [[0] * 6, [5, 0, 0, 0, 0, 0], [3, 3, 3, 3, 3, 3], [1, 9, 1, 9, 1, 9], [100, 40, 20, 12, 8, 6]])
def test_factors_are_shares(times):
    d = good_turing(np.array(times))
    assert len(d) == 5 and (d > 0).all() and (d < 1).all()


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    for r in katz_scores(df, F.lit(False)).collect():
        assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def test_clashing_columns_and_empty_table(spark, clashing, empty):
    odd = clashing.select("*", *[F.lit("x").alias(c) for c in ("kept", "block", "learn", "words", "base_score", "c0")])
    got = katz_scores(odd, F.lit(True))
    assert set(got.columns) == {*odd.columns, *RESULTS} - {"text"}
    assert got.count() == odd.count()
    assert katz_scores(empty, F.lit(True)).count() == 0


def test_odd_rows(spark, documents, rows_of_documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    check_query(spark, str(tmp_path), [(r[0], r[1]) for r in rows_of_documents])


def check_query(spark, folder, rows):
    def out(doc_id):
        return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1

    model = ByHand([t for i, t in rows if not out(i)], 2)
    want = sorted([(i if i is not None else -1, out(i), *model.result(t)) for i, t in rows])
    got = op12_katz(spark, folder).collect()
    assert len(got) == len(want)
    for r, w in zip(sorted(got, key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"])), want):
        assert ((-1 if r["doc_id"] is None else r["doc_id"]), r["held_out"]) == w[:2]
        same(r, w[2:])


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check_query(spark, folder, rows)


def test_better_than_single_words(spark):
    got = op12_katz(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
