"""Line dedup: lines that many documents repeat stay in one of them.

Only 128-bit hashes of line keys travel.  They are range-partitioned by hash and
document and sorted by position in it, so that a line that a third of all
documents share is spread over many partitions like any other range.  Streaming
through a partition marks the first occurrence of a hash in each document; these
are counted per hash.  The lines of repeated keys outside their last document
become bits of sparse bitmaps, one word per 64 lines; a document without such
lines has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import BLANKS, ascii_lower, document_table, fresh, written

MIN_LENGTH, MIN_DOCUMENTS = 40, 5
BITS = 64

ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS dropped FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def line_key(line: Column) -> Column:
    """Trimmed of ASCII white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def text_lines(text: Column) -> Column:
    """Lines between line feeds; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keep_bitmaps(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_length: int = MIN_LENGTH,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """``(doc_id, text_hash, keep)`` for every text that loses lines.

    ``keep`` lists ``(word, bits)``: bit ``i`` of word ``w`` is 1 if line
    ``64 * w + i`` stays; words that are not listed keep all their lines.
    A line's key counts if it has ``min_length`` code points or more and occurs
    in ``min_documents`` distinct documents or more; all its lines go but those
    of the largest document that holds it.  Rows of equal ``doc_id`` are one
    document, rows without one are together one document that comes first.
    """
    lines = df.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_hash"),
        F.posexplode(text_lines(F.col(text))).alias("position", "line"),
    ).where(F.char_length("line") >= min_length)
    key = line_key(F.col("line"))
    hashed = (
        lines.withColumn("key", key)
        .where(F.char_length("key") >= min_length)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            "doc_id",
            "position",
            "text_hash",
        )
        .repartitionByRange("h1", "h2", "doc_id")
        .sortWithinPartitions("h1", "h2", "doc_id", "position")
    )
    # a range partition holds all lines of a hash and document, in order
    in_document = Window.partitionBy("h1", "h2", "doc_id").orderBy("position")
    hashed = written(hashed.withColumn("first", F.row_number().over(in_document) == 1), "line-hashes")
    # written, so that adaptive execution knows the size of either side of the join and can split a hot line
    repeated = written(
        hashed.where("first")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("last_doc"))
        .where(F.col("documents") >= min_documents)
        .select("h1", "h2", "last_doc"),
        "repeated-lines",
    )
    dropped = hashed.join(repeated, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    bit = F.expr(f"shiftleft(1L, cast(position % {BITS} as int))")
    return (
        dropped.groupBy("doc_id", "text_hash", F.floor(F.col("position") / BITS).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits"))).alias("keep"))
    )


def with_bitmaps(
    df: DataFrame, bitmaps: DataFrame, text: str = "text", doc_id: str = "doc_id", into: str = "keep"
) -> DataFrame:
    """``df`` with the bitmap of each text, null if all its lines stay; a column named ``into`` is replaced."""
    rows = df.drop(into)
    own_id, own_hash, key = fresh(rows, "bitmap_doc", "bitmap_hash", "text_hash")
    renamed = bitmaps.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("keep").alias(into))
    rows = rows.withColumn(key, F.xxhash64(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_hash))
    return rows.join(renamed, same, "left").drop(own_id, own_hash, key)


def kept_lines(text: Column, keep: Column) -> Column:
    """Lines that a bitmap keeps, in their order."""

    def stays(_: Column, i: Column) -> Column:
        word = F.get(F.filter(keep, lambda e: e["word"] == F.floor(i / BITS)), F.lit(0))
        return F.coalesce(F.getbit(word["bits"], F.pmod(i, F.lit(BITS))) == 1, F.lit(True))

    return F.when(keep.isNull(), text_lines(text)).otherwise(F.filter(text_lines(text), stays))


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits: int) -> DataFrame:
    """``df`` with its texts without repeated lines, and ``n_lines``, ``n_dropped``.

    Null and empty texts have one empty line and become empty.  Columns named
    ``n_lines`` and ``n_dropped`` are replaced, all others stay.
    """
    rows = df.drop("n_lines", "n_dropped")
    keep, kept = fresh(rows, "line_keep", "line_kept")
    marked = with_bitmaps(rows, keep_bitmaps(df, text, doc_id, **limits), text, doc_id, keep)
    return (
        marked.withColumn(kept, kept_lines(F.col(text), F.col(keep)))
        .withColumn("n_lines", F.size(text_lines(F.col(text))).cast("long"))
        .withColumn("n_dropped", F.col("n_lines") - F.size(kept))
        .withColumn(text, F.array_join(kept, "\n"))
        .drop(keep, kept)
    )


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(document_table(spark, folder).select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )
