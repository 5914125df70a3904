import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import (
    mix, mixed_documents, mixture, op10_mix_sources, splitting_tree, water_fill, word_count, write_mixture,
)


def test_water_fill():
    assert water_fill([100, 100], [1, 1], 150, 2) == [75, 75]
    assert water_fill([10, 100], [3, 1], 165, 2) == [20, 145]
    assert water_fill([10, 10], [3, 1], 100, 2) == [20, 20]
    assert water_fill([0, 10], [3, 1], 15, 2) == [0, 15]
    assert water_fill([], [], 0, 2) == []


def test_splitting_tree_is_exact_and_repeats():
    quotas = [1000, 10, 0, 333]
    bounds = splitting_tree(quotas, 7, 3)
    counts = np.diff(bounds, axis=1)
    assert (counts >= 0).all() and counts.sum(axis=1).tolist() == quotas
    assert abs(counts.sum(axis=0) - sum(quotas) / 7).max() <= 3
    assert (bounds == splitting_tree(quotas, 7, 3)).all()
    # each shard's share of a source is near the source's share of all draws
    many = np.mean([np.diff(splitting_tree(quotas, 7, seed), axis=1) for seed in range(60)], axis=0)
    assert abs(many[0] - 1000 / 7).max() < 4


def test_targets_are_met(spark):
    n = 3000
    df = spark.range(n).selectExpr(
        "id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text",
        "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', id % 11) end as source",
    )
    got = mix(df, word_count(F.col("text")), block_size=500).cache()
    rows = got.withColumn("taken", F.col("size") * F.size("draws"))
    by = rows.groupBy("source").agg(
        F.sum("size").alias("size"), F.max("source_size").alias("stated"), F.max("target").alias("target"), F.sum("taken").alias("taken")
    ).collect()
    order = sorted((r for r in by), key=lambda r: (r["source"] is None, r["source"] or ""))
    total = sum(r["size"] for r in by)
    want = water_fill([r["size"] for r in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * total, 2)
    for row, target in zip(order, want):
        assert row["size"] == row["stated"]
        assert row["target"] == pytest.approx(target)
        assert abs(row["taken"] - target) <= 37
    assert rows.where("taken > 2 * size").count() == 0
    again = mix(df.repartition(7), word_count(F.col("text")), block_size=500)
    assert again.select("doc_id", "draws").exceptAll(got.select("doc_id", "draws")).count() == 0
    # runs of a source's blocks are disjoint: a block copy lies in one shard
    shards = mixture(got).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(shards) == 32


def test_written_shards(spark, documents, tmp_path):
    mixed = mixed_documents(documents)
    write_mixture(mixed, f"{tmp_path}/mix")
    back = spark.read.parquet(f"{tmp_path}/mix")
    assert back.count() == mixed.select(F.sum(F.size("draws"))).first()[0]
    assert back.selectExpr("sum(size) as n").first()["n"] == pytest.approx(1.5 * mixed.selectExpr("sum(size) as n").first()["n"], rel=0.5)


def test_edges(documents, clashing, empty, rows_of_documents):
    got = mixed_documents(documents)
    assert got.count() == len(rows_of_documents)
    assert got.where("doc_id = 120").first()["size"] == 0
    twins = [r["draws"] for r in got.where("doc_id = 3").collect()]
    assert len(twins) == 3 and twins[0] == twins[1] == twins[2]
    assert mixed_documents(clashing).count() == len(rows_of_documents)
    assert mixed_documents(empty).count() == 0 and mixture(mixed_documents(empty)).count() == 0


def targets_by_hand(sizes):
    """Source -> target, by resharing the excess until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is not None and [0, *map(ord, s)]) or [1])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {s: 0.0 for s in order if not sizes[s]}
    while True:
        free = [s for s in order if s not in fixed]
        rest, mass = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / mass > 2 * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / mass for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("kind", ["odd rows", "sf0.001"])
def test_query_against_a_plain_mix(spark, documents, tmp_path, kind):
    import re

    folder = "/root/testdata/sf0.001"
    if kind == "odd rows":
        folder = str(tmp_path)
        # a source without a word, and one whose name sorts by code point behind all letters
        more = spark.createDataFrame([(900, None, "en", "zero", 0), (901, " \t", "en", "zero", 0), (902, "a b c", "en", "é", 0)], documents.schema)
        documents.union(more).write.parquet(f"{folder}/documents.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text").collect()
    words = [len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")) for r in rows]
    sizes = {}
    for r, n in zip(rows, words):
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
    target = targets_by_hand(sizes)
    got = op10_mix_sources(spark, folder)
    found = got.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").distinct(), "doc_id", "left").collect()
    assert got.count() == len(rows)
    assert sorted(r["size"] for r in got.collect()) == sorted(words)
    taken = {}
    for r in found:
        if r["doc_id"] is None:
            continue
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        assert len(r["shards"]) * r["size"] == r["taken"]
    for r in got.collect():
        key = (r["source_size"], round(r["target"], 6))
        taken[key] = taken.get(key, 0) + r["taken"]
    largest = max(words)
    for s, t in target.items():
        same = [o for o in target if (sizes[o], round(target[o], 6)) == (sizes[s], round(t, 6))]
        assert abs(taken.get((sizes[s], round(t, 6)), 0) - len(same) * t) <= len(same) * largest
    again = op10_mix_sources(spark, folder)
    assert again.exceptAll(got).count() == 0
