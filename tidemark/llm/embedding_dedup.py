"""Near-duplicate embeddings by iterative quantisation and Hamming tables.

Rotations learned by iterative quantisation turn a vector into balanced binary
codes.  The codes are cut into the keys of several tables; vectors that share a
key in some table are candidates and are compared by their original vectors.

A bucket is split into blocks of bounded size, and each pair of its blocks is
one group of work: a matrix product, which hands on one row per vector with the
number of its links and one vector that it hangs together with, never the pairs.
A pair counts in the first table in which it meets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import written
from tidemark.llm.components import components

SEED, THRESHOLD = 20_261_203, 0.9
#: The fit reads about this many vectors.
SAMPLE = 8_192
ITERATIONS = 50
#: Vectors wanted in a bucket on average, and vectors of a bucket compared at once.
BUCKET_ROWS, BLOCK_ROWS = 256, 1_024
#: Share of the pairs at the threshold that some table must bring together.
RECALL = 0.97
MOST_BITS = 20


def itq_rotation(sample: np.ndarray, bits: int, seed: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Projection to ``bits`` directions whose signs lose least.

    Principal directions are rotated so that the rotated sample comes near the
    corners of the cube: the signs are fixed and the best rotation for them is
    taken, in turns.
    """
    rng = np.random.default_rng(seed)
    _, vectors = np.linalg.eigh(sample.T @ sample)
    principal = vectors[:, ::-1][:, :bits]
    rotation, _ = np.linalg.qr(rng.normal(size=(principal.shape[1],) * 2))
    projected = sample @ principal
    for _ in range(iterations):
        left, _, right = np.linalg.svd(projected.T @ np.where(projected @ rotation >= 0, 1.0, -1.0))
        rotation = left @ right
    return principal @ rotation


@dataclass(frozen=True)
class Tables:
    """Projections of the codes; ``bits`` of them make a table's key."""

    projections: np.ndarray
    bits: int
    tables: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Key of every vector in every table."""
        signs = (unit @ self.projections) >= 0
        chosen = signs[:, : self.tables * self.bits].reshape(len(unit), self.tables, self.bits)
        return chosen @ (1 << np.arange(self.bits, dtype=np.int64))


def fit_tables(sample: np.ndarray, rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Tables:
    """Tables for ``rows`` vectors, fitted to unit vectors ``sample``.

    The key length follows from the number of rows and the bucket size; the
    number of tables from the chance that two vectors at the threshold agree in
    all bits of a key.  That chance holds for planes through the origin, so the
    vectors are not centered.  Several rotations are learned if one has too few
    bits.
    """
    dims = sample.shape[1]
    bits = min(max(4, math.ceil(math.log2(max(2, rows) / BUCKET_ROWS))), MOST_BITS, dims)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    tables = math.ceil(math.log(1 - recall) / math.log(1 - same))
    per_rotation = dims // bits * bits
    rotations = math.ceil(tables * bits / per_rotation)
    projections = [itq_rotation(sample, dims, SEED + i)[:, :per_rotation] for i in range(rotations)]
    return Tables(np.concatenate(projections, axis=1), bits, tables)


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors as rows, filled up with zeros to ``dims``."""
    out = np.zeros((len(vectors), dims))
    for i, vector in enumerate(vectors):
        values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
        out[i, : len(values)] = values / np.abs(values).max()
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _hung_together(linked: np.ndarray) -> np.ndarray:
    """Least member of each row's component in a symmetric link matrix."""
    least = np.arange(len(linked))
    while True:
        best = np.minimum(least, np.where(linked, least[None, :], len(linked)).min(axis=1))
        best = best[best]
        if (best == least).all():
            return least
        least = best


def _compare(group: pa.Table, dims: int, threshold: float) -> pa.Table:
    """Links within one pair of blocks.

    Of a block with itself all pairs count, else those across.  Ties in the
    class are no links: a class stands for equal vectors.
    """
    table, first_block, second_block = (group.column(c)[0].as_py() for c in ("bucket_table", "block", "other_block"))
    unit = _matrix(group.column("vector").combine_chunks(), dims)
    keys = np.array(group.column("keys").to_pylist(), dtype=np.int64)
    own = group.column("own_block").to_numpy()
    weight = group.column("copies").to_numpy()
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if first_block != second_block:
        linked &= own[:, None] != own[None, :]
    counted = linked.copy()
    for earlier in range(table):
        counted &= keys[:, None, earlier] != keys[None, :, earlier]
    links = counted.astype(np.float64) @ weight
    heads = _hung_together(linked)
    some = np.flatnonzero(linked.any(axis=1))
    classes = group.column("class").to_numpy()
    return pa.table(
        {
            "class": pa.array(classes[some]),
            "links": pa.array(np.rint(links[some]).astype(np.int64)),
            "head": pa.array(classes[heads[some]]),
        }
    )


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors``.

    Vectors of equal length link when their cosine is ``threshold`` or more;
    about ``recall`` of the pairs right at the threshold are found, and more of
    closer ones.  Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing.  Equal vectors are compared once
    and count as often as they occur.  ``kept`` marks the smallest id of each
    component; a row without id is kept only where no row of its component has
    one.  An empty table gives none.
    """
    spark = vectors.sparkSession
    values = F.col(embedding).cast("array<double>")
    good = F.coalesce(
        (F.size(values) > 0)
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(values, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.when(good, F.xxhash64(values)).alias("class"), values.alias("vector")
    )
    classes = written(
        rows.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")),
        "vectors",
    )
    about = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    n, dims = about["n"], about["dims"] or 1
    # classes are hashes, so a residue of them is a sample
    sample = classes.where(F.pmod("class", F.lit(max(1, -(-n // SAMPLE)))) == 0).select("vector").toArrow()
    tables = fit_tables(_matrix(sample.column(0).combine_chunks(), dims), n, threshold, recall)
    shared = spark.sparkContext.broadcast(tables)

    @F.arrow_udf("array<bigint>")
    def table_keys(batch: pa.Array) -> pa.Array:
        keys = shared.value.keys(_matrix(batch, dims))
        return pa.array(list(keys), pa.list_(pa.int64()))

    coded = written(classes.drop("least_id").withColumn("keys", table_keys("vector")), "codes")
    placed = coded.select("class", F.size("vector").alias("length"), F.posexplode("keys").alias("bucket_table", "bucket"))
    bucket = ["bucket_table", "bucket", "length"]
    # buckets of one class end here
    sized = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("class", "bucket_table"), F.col("blocks")).cast("int")
    work = (
        placed.join(sized, bucket)
        .withColumn("blocks", blocks)
        .withColumn("own_block", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            *bucket,
            "class",
            "own_block",
            F.least("own_block", "with").alias("block"),
            F.greatest("own_block", "with").alias("other_block"),
        )
        .join(coded, "class")
    )
    found = written(
        work.groupBy(*bucket, "block", "other_block").applyInArrow(
            lambda group: _compare(group, dims, threshold), "class bigint, links bigint, head bigint"
        ),
        "block-links",
    )
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("class").alias("a"), F.col("head").alias("b")))
    whole = (
        classes.select("class", "copies", "least_id")
        .join(joined.withColumnRenamed("node", "class"), "class", "left")
        .join(links, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    least = whole.groupBy("component").agg(F.min("least_id").alias("component_id"))
    result = whole.join(least, "component").select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    return (
        rows.drop("vector")
        .join(result, "class", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet")).withColumn(
        "component_id", F.col("component_id").cast("long")
    )
