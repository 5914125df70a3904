import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions.prefix import global_rank, prefix_sums, quantiles_of_counts, value_counts

RNG = np.random.default_rng(7)
SHAPES = {
    "spread": RNG.normal(size=700),
    "ties": RNG.integers(0, 6, 700).astype(float),
    "one hot value": np.r_[np.full(400, 0.5), RNG.uniform(size=300)],
    "all equal": np.full(50, 2.0),
    "single": np.array([3.0]),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("buckets", [4, 256])
@pytest.mark.parametrize("descending", [True, False])
def test_prefix_sums(spark, shape, buckets, descending):
    values, counts = np.unique(SHAPES[shape], return_counts=True)
    df = spark.createDataFrame(pd.DataFrame({"v": values, "n": counts})).repartition(3)
    got = prefix_sums(df, "v", ["n"], descending=descending, buckets=buckets).toPandas().sort_values("v", ascending=not descending)
    expected = counts[::-1] if descending else counts
    assert list(got["cum_n"]) == list(np.cumsum(expected))
    assert set(got["total_n"]) == {counts.sum()}
    following = list(got["v"])[1:] + [None]
    assert [None if pd.isna(x) else x for x in got["next_value"]] == following


@pytest.mark.parametrize("bounded", [True, False])
def test_quantiles_per_group_match_numpy(spark, bounded):
    frame = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in SHAPES.items()])
    df = spark.createDataFrame(frame).union(spark.createDataFrame([("ties", None), ("empty", None)], "g string, v double"))
    probs = {"p25": 0.25, "p50": 0.5, "p90": 0.9}
    got = quantiles_of_counts(value_counts(df, "v", ["g"]), "v", probs, ["g"], buckets=8, bounded_groups=bounded)
    found = {r["g"]: r for r in got.collect()}
    for g, v in SHAPES.items():
        for name, p in probs.items():
            assert found[g][name] == pytest.approx(np.quantile(v, p)), (g, name)
    assert "empty" not in found


@pytest.mark.parametrize("shape", SHAPES)
def test_global_rank(spark, shape):
    frame = pd.DataFrame({"s": SHAPES[shape], "k": RNG.permutation(len(SHAPES[shape])).astype(np.int64)})
    got = global_rank(spark.createDataFrame(frame).repartition(5), "s", "k").toPandas()
    expected = frame.sort_values(["s", "k"], ascending=[False, True]).reset_index(drop=True)
    ranked = got.sort_values("rank_desc").reset_index(drop=True)
    assert list(ranked["k"]) == list(expected["k"])
    assert list(ranked["rank_desc"]) == list(range(1, len(frame) + 1))


def test_hot_score_is_ranked_in_many_tasks(spark):
    """A score shared by all rows must not end in one ranking partition, and the input is evaluated once."""
    from tidemark.functions import ranges

    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(20_000).select(F.col("id").alias("k"), F.lit(0.5).alias("s")).mapInPandas(watched, "k long, s double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ranges.numbered(df, [F.desc("s"), F.asc("k")], "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen.value == 20_000
    assert len(placed.inputFiles()) >= 2
    plan = global_rank(df, "s", "k")
    assert plan.agg(F.max("rank_desc"), F.countDistinct("rank_desc")).first()[:] == (20_000, 20_000)
    assert plan.where("rank_desc = k + 1").count() == 20_000


@pytest.mark.parametrize("make", [str, lambda i: f"customer-{i:06d}", lambda i: "abcé"[i % 4] * (i // 4 % 9) + f"{i}", lambda i: f"{i % 7}"])
def test_global_rank_with_text_keys_on_shared_scores(spark, make):
    n = 3000
    frame = pd.DataFrame({"s": [0.25 if i % 3 else 0.75 for i in range(n)], "k": [make(i) for i in range(n)]})
    got = global_rank(spark.createDataFrame(frame).repartition(5), "s", "k").toPandas()
    expected = sorted(zip(-frame["s"], (k.encode() for k in frame["k"])))
    ranked = got.sort_values("rank_desc")
    assert list(zip(-ranked["s"], (k.encode() for k in ranked["k"]))) == expected
    assert list(ranked["rank_desc"]) == list(range(1, n + 1))


def test_global_rank_refuses_keys_without_order(spark):
    with pytest.raises(AnalysisException):
        global_rank(spark.createDataFrame([(0.5, {1: 2})], "s double, k map<int,int>"), "s", "k").count()
    listed = global_rank(spark.createDataFrame([(0.5, [2]), (0.5, [1])], "s double, k array<int>"), "s", "k")
    assert [r["rank_desc"] for r in listed.orderBy("k").collect()] == [1, 2]


def test_null_scores_rank_last(spark):
    df = spark.createDataFrame([(None, 1), (0.1, 2), (0.9, 3)], "s double, k long")
    assert [r["k"] for r in global_rank(df, "s", "k").orderBy("rank_desc").collect()] == [3, 2, 1]
