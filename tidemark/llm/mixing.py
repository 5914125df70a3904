"""Mixing sources to target weights.

Every source is laid out in the order of a seeded hash and cut into blocks of
about ``block_size`` units (words).  Its target fixes how many whole rounds
over the blocks are taken and how many blocks of one further round, the last of
them up to the row that comes nearest.  These exact block quotas are split
among the output shards by a tree: each node divides its quotas between its two
halves by a multivariate hypergeometric draw.  A shard thus owns a run of the
permuted blocks of every source, disjoint from all other shards' runs, and
orders its rows by a second hash.

Whether a row is taken depends on its source and its hash alone, so no row is
moved to decide it, a hot source is read in parallel, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark.llm.common import WORD, document_table, fresh, written

SEED, SHARDS, BLOCK_WORDS = 20_261_201, 32, 1_000_000
SPAN = float(1 << 63)
#: Rows of the per-source table up to which a broadcast is asked for.
BROADCAST_SOURCES = 100_000

MODEL = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("blocks", T.LongType()),
        T.StructField("rounds", T.LongType()),
        T.StructField("remainder", T.DoubleType()),
    ]
)


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, limit: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``limit`` times its size.

    What is over a limit is shared again by weight among the others.  If all
    limits together are below ``total``, every source gets its limit.
    """
    targets = [0.0] * len(sizes)
    open_ = [i for i, size in enumerate(sizes) if size > 0 and weights[i] > 0]
    rest = float(total)
    while open_:
        mass = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / mass >= limit * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = rest * weights[i] / mass
            break
        for i in over:
            targets[i] = limit * sizes[i]
            rest -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def splitting_tree(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Start of every shard's run in each source's block draws.

    Row ``s`` has ``shards + 1`` bounds from 0 to ``quotas[s]``.  A node with
    several shards gives its left half a share of its draws in proportion to
    the number of shards, drawn without replacement over all sources at once.
    """
    counts = np.zeros((len(quotas), shards), dtype=np.int64)

    def split(quota: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            counts[:, low] = quota
            return
        middle = (low + high) // 2
        draws = int(quota.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(quota, draws, method="marginals")
        split(left, low, middle)
        split(quota - left, middle, high)

    split(np.array(quotas, dtype=np.int64), 0, shards)
    return np.concatenate([np.zeros((len(quotas), 1), np.int64), counts.cumsum(axis=1)], axis=1)


def _near(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_SOURCES else table


def mix(
    df: DataFrame,
    size: Column,
    source: str = "source",
    identity: Sequence[str] = ("doc_id", "text"),
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    block_size: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """Rows of ``df`` with ``size``, ``source_size``, ``target`` and ``draws``.

    ``weights`` repeat over the sources in code point order, null last; they
    share ``share`` times all sizes, each source up to ``limit`` times its own.
    ``draws`` has one ``(round, shard, position)`` for every copy that the
    mixture takes of the row, none for a row that it leaves out.  Columns of
    these names are replaced.  One row per source reaches the driver.

    A null source is a source.  Rows of size 0 are drawn like others and add
    nothing.  Equal rows (by ``identity``) share their fate.  An empty table
    gives no rows.
    """
    spark = df.sparkSession
    rows = df.drop("size", "source_size", "target", "draws")
    key, own = fresh(rows, "mix_key", "mix_source")
    rows = rows.withColumns(
        {
            "size": size,
            key: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in identity]), 1),
            own: F.col(source),
        }
    )
    slim = written(rows.select(F.col(own).alias("source"), "size", F.col(key).alias("key")), "mix-sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in totals]
    targets = water_fill(
        sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), limit
    )
    plan = []
    for row, target in zip(totals, targets):
        n = row["n"]
        rounds = int(target // n) if n else 0
        plan.append((row["source"], n, target, max(1, -(-n // block_size)), rounds, target - rounds * n))
    model = spark.createDataFrame(plan, MODEL)

    block = F.least(F.floor(F.col("key") / SPAN * F.col("blocks")), F.col("blocks") - 1)
    placed = slim.join(_near(model, len(plan)), slim["source"].eqNullSafe(model["source"])).select(
        model["source"], "size", "key", "remainder", block.alias("block")
    )
    # the block in which a source's remainder ends, and what earlier blocks leave of it
    sequence = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        placed.groupBy("source", "remainder", "block")
        .agg(F.sum("size").alias("in_block"))
        .withColumn("left", F.col("remainder") - F.coalesce(F.sum("in_block").over(sequence), F.lit(0)))
        .where((F.col("left") > 0) & (F.col("left") <= F.col("in_block")))
        .select(F.col("source").alias("in_source"), F.col("block").alias("last_block"), "left")
    )
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        placed.join(
            last, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("block") == F.col("last_block")), "inner"
        )
        .groupBy("source", "last_block", "left", "key")
        .agg(F.sum("size").alias("size"))
        .withColumn("until", F.sum("size").over(inside) - F.col("size") / 2)
        .groupBy("source", "last_block")
        .agg(F.max(F.when(F.col("until") <= F.col("left"), F.col("key"))).alias("last_key"))
        .collect()
    )
    end = {r["source"]: r for r in ends}
    quotas, through = [], []
    for name, _, _, blocks, rounds, remainder in plan:
        found = end.get(name) if remainder > 0 else None
        quotas.append(rounds * blocks + (found["last_block"] + 1 if found else 0))
        # rows of the last block before the first one taken: the block before it ends the round
        through.append(-1 if not found else found["last_key"])
        if found and found["last_key"] is None:
            through[-1] = int(found["last_block"] / blocks * SPAN) - 1 if found["last_block"] else -1
    bounds = splitting_tree(quotas, shards, seed) if plan else np.zeros((0, shards + 1), np.int64)
    decided = spark.createDataFrame(
        [(*p[:5], t, b.tolist()) for p, t, b in zip(plan, through, bounds)],
        "mix_name string, source_size long, target double, blocks long, rounds long, through long, bounds array<long>",
    )

    names = fresh(rows, "mix_name", "blocks", "rounds", "through", "bounds")
    renamed = dict(zip(("mix_name", "blocks", "rounds", "through", "bounds"), names))
    decided = decided.withColumnsRenamed(renamed)
    name, blocks, rounds, through, bounds = (F.col(n) for n in names)
    at = F.least(F.floor(F.col(key) / SPAN * blocks), blocks - 1)

    def draw(turn: Column) -> Column:
        shard = F.size(F.filter(bounds, lambda b: b <= turn * blocks + at)) - 1
        return F.struct(
            turn.cast("int").alias("round"),
            shard.cast("int").alias("shard"),
            F.xxhash64(F.lit(seed + 1), turn, F.col(key)).alias("position"),
        )

    copies = rounds + F.when(F.col(key) <= through, 1).otherwise(0)
    drawn = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), draw))
    empty = F.array().cast("array<struct<round:int,shard:int,position:bigint>>")
    return (
        rows.join(_near(decided, len(plan)), F.col(own).eqNullSafe(name))
        .withColumn("draws", F.coalesce(drawn, empty))
        .drop(key, own, *names)
    )


def mixture(mixed: DataFrame) -> DataFrame:
    """One row per drawn copy, with ``round``, ``shard`` and ``position``."""
    kept = [c for c in mixed.columns if c.lower() not in ("draws", "round", "shard", "position")]
    return mixed.select(*kept, F.inline("draws"))


def write_mixture(mixed: DataFrame, path: str) -> None:
    """Shards as folders ``shard=<n>``, each shuffled by its positions; several tasks may write one."""
    rows = mixture(mixed)
    rows.repartitionByRange("shard", "position").sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path)


def mixed_documents(documents: DataFrame) -> DataFrame:
    return mix(documents, word_count(F.col("text")))


def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """What the mixture takes of every document: its words times its draws."""
    mixed = mixed_documents(document_table(spark, folder).select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("draws")).alias("taken"),
        F.transform("draws", lambda d: d["shard"]).alias("shards"),
    )
