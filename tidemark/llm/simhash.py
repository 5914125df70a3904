"""Document fingerprints: SimHash, and permuted block tables to search them.

Every distinct word of a text votes on 64 bits by its hash, with a weight that
grows with the logarithm of its count.  Two 32-bit counters share a long, so
that one pass of 33 sums gives all bits.  Texts that differ in ``radius`` bits at
most agree in some of the blocks that the bits are divided into; a table for
each choice of blocks finds all of them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import WORD, ascii_lower, document_table, written

BITS, HALF = 64, 32
PAIR = (1 << HALF) + 1  # the lowest bit of either half
#: Weights are in quarters, which keeps a counter below 2**32 for any text.
QUARTERS = 4
RADIUS, BLOCKS = 3, 6
NO_ID = -(1 << 63)
#: The fixed share of a text's end that the edit of the query replaces.
EDITED_SHARE = 4


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORD})"))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fingerprint`` of every text; ``keys`` must be unique.

    A bit is 1 if the words with it outweigh those without.  A text without
    words, or null, has fingerprint 0.  Rows that are already partitioned by
    keys are not moved.
    """
    own = F.expr("word_hash")
    counted = (
        texts.select(*keys, F.explode_outer(words(F.col(text))).alias("word"))
        .select(*keys, F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("word_hash"))
        .groupBy(*keys, "word_hash")
        .agg(F.count("word_hash").alias("n"))
        .withColumn("weight", F.when(own.isNotNull(), F.round(QUARTERS * (1 + F.log2("n")))).otherwise(0).cast("long"))
    )
    ones = [
        F.sum(F.shiftright("word_hash", i).bitwiseAND(F.lit(PAIR)) * F.col("weight")).alias(f"ones{i}")
        for i in range(HALF)
    ]
    summed = counted.groupBy(*keys).agg(F.sum("weight").alias("total"), *ones)

    def bit(i: int) -> Column:
        both = F.col(f"ones{i % HALF}")
        n = both.bitwiseAND(F.lit((1 << HALF) - 1)) if i < HALF else F.shiftrightunsigned(both, HALF)
        return F.when(2 * n > F.col("total"), F.lit(1 << i if i < BITS - 1 else NO_ID)).otherwise(0)

    value = bit(0)
    for i in range(1, BITS):
        value = value.bitwiseOR(bit(i))
    return summed.select(*keys, value.alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - distance(a, b) / BITS


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def table_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bits of every choice of ``blocks - radius`` blocks, as signed longs.

    ``radius`` differing bits lie in as many blocks at most, so some table's
    bits are all equal.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def within_radius(
    queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """``(query, fingerprint, distance)`` for all pairs within ``radius``, each once.

    Both inputs have a column ``fingerprint``; equal ones are looked up once, so
    that a group of copies costs no more than one text.  A pair is reported by
    the first table in which it meets.
    """
    masks = table_masks(radius, blocks)
    tables = F.array(*[F.lit(m) for m in masks])

    def placed(df: DataFrame, name: str) -> DataFrame:
        unique = df.where(F.col("fingerprint").isNotNull()).select(F.col("fingerprint").alias(name)).distinct()
        return unique.select(name, F.posexplode(tables).alias("block_table", "mask")).select(
            name, "block_table", F.col(name).bitwiseAND(F.col("mask")).alias("block_bits")
        )

    other = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*[F.when(other.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    met = placed(queries, "query").join(placed(fingerprints, "fingerprint"), ["block_table", "block_bits"])
    gap = distance(F.col("query"), F.col("fingerprint"))
    return met.where((gap <= radius) & (first == F.col("block_table"))).select(
        "query", "fingerprint", gap.alias("distance")
    )


def next_documents(documents: DataFrame) -> DataFrame:
    """``(id, hash, n_chars, n_rows, next_id, next_hash)`` of each distinct document.

    Documents are ordered by id (none first), then by the hash of the text; the
    first one follows the last.  Ids alone are range-partitioned and ordered
    within their partitions; one row per partition joins these.
    """
    ids = documents.groupBy("id", "hash", "n_chars").agg(F.count(F.lit(1)).alias("n_rows"))
    placed = written(
        ids.repartitionByRange("id", "hash").withColumn("part", F.spark_partition_id()), "document-order"
    )
    order = [F.col("id"), F.col("hash")]
    here = F.struct("id", "hash")
    parts = Window.orderBy("part")
    edges = (
        placed.groupBy("part")
        .agg(F.min(here).alias("first"))
        .select(
            "part",
            F.coalesce(
                F.lead("first").over(parts),
                F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            ).alias("follows"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order)
    return (
        placed.withColumn("next", F.lead(here).over(inside))
        .join(edges, "part")
        .withColumn("next", F.coalesce("next", "follows"))
        .select("id", "hash", "n_chars", "n_rows", F.col("next.id").alias("next_id"), F.col("next.hash").alias("next_hash"))
    )


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    Null ids are taken as the smallest long.  ``n_within`` counts, for ids
    divisible by 20, the other documents within ``RADIUS`` bits; it is null for
    other ids.
    """
    documents = document_table(spark, folder).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )
    documents = documents.withColumn("hash", F.xxhash64("text"))
    order = written(next_documents(documents.select("id", "hash", F.char_length("text").alias("n_chars"))), "next")
    same = Window.partitionBy("id", "hash").orderBy("id")
    unique = documents.withColumn("copy", F.row_number().over(same)).where("copy = 1").drop("copy")
    n_edited = F.expr(f"n_chars div {EDITED_SHARE}").cast("int")
    ends = (
        unique.withColumnsRenamed({"id": "next_id", "hash": "next_hash"})
        .join(order, ["next_id", "next_hash"])
        .select("id", "hash", "n_chars", F.substring("text", F.lit(1), n_edited).alias("end"))
    )
    begin = F.substring("text", F.lit(1), F.col("n_chars") - n_edited)
    edited = unique.join(ends, ["id", "hash"]).withColumn("edited", F.concat(begin, "end"))
    both = edited.select("id", "hash", F.posexplode(F.array("text", "edited")).alias("which", "text"))
    prints = (
        fingerprints(both, ["id", "hash", "which"])
        .groupBy("id", "hash")
        .agg(
            F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"),
            F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
        )
    )
    digests = edited.select("id", "hash", F.sha2("edited", 256).alias("edited_sha256"))
    found = written(prints.join(digests, ["id", "hash"]), "fingerprints")

    counted = order.join(found, ["id", "hash"]).groupBy("fingerprint").agg(F.sum("n_rows").alias("n_documents"))
    asked = found.where("id % 20 = 0")
    near = (
        within_radius(asked, found)
        .join(counted, "fingerprint")
        .groupBy(F.col("query").alias("fingerprint"))
        .agg((F.sum("n_documents") - 1).alias("n_found"))
    )
    following = found.select(
        F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("fingerprint").alias("next_fingerprint")
    )
    mine, changed, after = (F.col(c) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    return (
        order.join(found, ["id", "hash"])
        .join(following, ["next_id", "next_hash"])
        .join(near, "fingerprint", "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
        .select(
            F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
            F.col("n_chars").cast("long").alias("n_chars"),
            "edited_sha256",
            as_text(mine).alias("fingerprint"),
            as_text(changed).alias("edited_fingerprint"),
            likeness(mine, changed).alias("near_edited"),
            likeness(mine, after).alias("near_next"),
            F.when(F.col("id") % 20 == 0, F.col("n_found")).alias("n_within"),
        )
    )
