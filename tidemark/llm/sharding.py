"""Sharding by a two-pass external shuffle.

The first pass scatters rows uniformly into buckets that fit into memory, by a
seeded hash.  The second loads one bucket at a time, puts it into random order
by Fisher-Yates and writes it.  A bucket's rows follow those of the buckets
before it, and shards are equal runs of these places: their counts differ by
one at most, whatever the rows hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.llm.common import document_table, fresh, new_folder, written

SEED, SHARDS, BUCKET_BYTES = 20_261_202, 40, 24 << 20
#: Tables of so many buckets' places are broadcast, 16 bytes a row; larger ones are joined like any other.
BROADCAST_BUCKETS = 1_000_000
#: What a row takes besides its text.
ROW_BYTES = 16


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and the bytes of a row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _bucket(identity: Sequence[Column], buckets: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(buckets)).cast("int")


def _numbered_copies(rows: DataFrame, size: Column, identity: Sequence[str], most_bytes: int, number: str) -> DataFrame:
    """``rows`` with a number that tells the copies of a very frequent row apart, 0 for all others.

    Rows that agree in ``identity`` meet in one bucket, where they would exceed
    it if they have more than ``most_bytes`` together.  Those that agree in every
    column are counted instead of moved, and unfolded again.
    """
    key = F.xxhash64(*[F.col(c) for c in identity])
    own_key, own_size = fresh(rows, "copy_key", "copy_size")
    many = written(
        rows.select(key.alias(own_key), size.alias(own_size))
        .groupBy(own_key)
        .agg(F.sum(own_size).alias("bytes"), F.count(F.lit(1)).alias("n"))
        .where((F.col("bytes") > most_bytes) & (F.col("n") > 1))
        .select(own_key),
        "many-copies",
    )
    if many.isEmpty():
        return rows.withColumn(number, F.lit(0).cast("long"))
    keyed = rows.withColumn(own_key, key)
    few = keyed.join(many, own_key, "left_anti").drop(own_key).withColumn(number, F.lit(0).cast("long"))
    (times,) = fresh(rows, "copies")
    counted = keyed.join(many, own_key, "left_semi").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(times))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1))
    return few.unionByName(counted.select(*rows.columns, copies.alias(number)))


def shuffled(
    df: DataFrame,
    size: Column,
    identity: Sequence[str] = ("doc_id", "text"),
    shards: int = SHARDS,
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
) -> DataFrame:
    """All rows of ``df`` with their ``shard`` and ``slot``, the place in it.

    ``size`` is a row's bytes; a bucket gets about ``bucket_bytes``.  The bucket
    comes from a hash of ``identity``, and of the number of the copy where
    copies of one row fill more than an eighth of a bucket.  The order is a
    function of the rows and the seed.  Columns named ``shard`` and ``slot`` are
    replaced; an empty table gives no rows.
    """
    rows = df.drop("shard", "slot")
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(1, -(-total["bytes"] // bucket_bytes))
    bucket, number = fresh(rows, "bucket", "copy")
    numbered = _numbered_copies(rows, size, identity, bucket_bytes // 8, number)
    columns = [F.col(c) for c in (*identity, number)]
    placed = numbered.withColumn(bucket, _bucket(columns, buckets, seed)).drop(number)
    # one bucket in each partition, in the same order on every run; grouped by the very column that
    # partitions, so that the texts are moved once
    full = (
        placed.repartitionById(buckets, F.col(bucket))
        .groupBy(bucket)
        .agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("rows"))
    )
    before = Window.orderBy("of_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket
    offsets = (
        placed.groupBy(F.col(bucket).alias("of_bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("of_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_place"))
    )
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    n = total["n"]
    shard = F.expr(f"place * {shards} div {max(1, n)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return (
        full.withColumn("rows", F.shuffle("rows", seed))
        .join(offsets, F.col(bucket) == F.col("of_bucket"))
        .select("first_place", F.posexplode("rows").alias("index", "row"))
        .withColumn("place", F.col("first_place") + F.col("index"))
        .withColumn("shard", shard.cast("int"))
        .select("row.*", "shard", (F.col("place") - first).alias("slot"))
    )


def write_shards(df: DataFrame, path: str, size: Column, **options: object) -> None:
    """Every shard as a folder ``shard=<n>``; its rows carry their ``slot``."""
    shuffled(df, size, **options).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Written shards; ``schema`` is that of the table that was sharded, which may have been empty."""
    fields = [f for f in schema if f.name not in ("shard", "slot")]
    return spark.read.schema(StructType([*fields, StructField("slot", LongType()), StructField("shard", IntegerType())])).parquet(path)


def op7_shard(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as shards, and read back for the digest of each row; an empty table gives no rows."""
    documents = document_table(spark, folder).select("doc_id", "text")
    path = new_folder(spark, "shards")
    write_shards(documents, path, text_size(F.col("text")))
    return read_shards(spark, path, documents.schema).select(
        "doc_id",
        text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
