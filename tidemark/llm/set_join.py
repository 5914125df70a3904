"""Joins of documents whose word shingles overlap, and their components.

A document is the set of its hashed shingles; equal sets are one class.  All
sets are ordered alike, by how often a shingle occurs (counted over the whole
corpus in a table of fixed size) and by its hash.  Two sets that reach the
similarity share one of the first shingles of either, so an inverted list is
kept of these only.

Two relations between sets save most comparisons.  Lists are cut into blocks by
position: the smaller set of a pair must have the shingle in its first block,
so pairs of later blocks are never formed, and sizes, positions and parity
bitmaps bound the overlap of the others; what short bitmaps let through meets
bitmaps that are as long as the sets before any text is moved.  And a set takes over the answers of a
set it is highly similar to: each list's members are first compared with two of
its sets only, what links to these is one component, and afterwards only pairs
of different components are left to compare.

Links lie within components.  To number them, the sets of a component are dealt
to blocks, and each pair of blocks is compared whole, as a product of matrices,
in one task: rows per set and block leave it, and no pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import document_table, fresh, releasing, written
from tidemark.llm.components import components
from tidemark.llm.wordhash import BLANK_SEPARATED, Words, mixed, word_runs

#: Shingles are counted in this many cells, sent and summed in chunks.
CELLS, CHUNK = 1 << 20, 1 << 14
#: Bits of the table that tells which texts have partners; its size is fixed.
WANTED_BITS = 1 << 23
BITMAP, WORDS_OF_BITMAP = 256, 4
#: Bits at most of the long bitmap of a set that fills the short one.
LONGEST_BITMAP = 1 << 17
NO_ID = -(1 << 63)
#: A component of more sets, or of more shingles in all, is cut into blocks.
BLOCK_SETS, BLOCK_SHINGLES = 128, 1 << 21
#: Columns of a block's matrix at a time.
STRIP = 1024
MAPS = [f"map{i}" for i in range(WORDS_OF_BITMAP)]


def _chain(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    h = hashes[starts]
    for j in range(1, length):
        h = mixed(h * np.uint64(31) + hashes[starts + j])
    return h


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` of the distinct shingles of each text, in this order.

    A text with fewer than ``k`` words has its whole sequence as one shingle.
    """
    bounds = words.bounds()
    n = np.diff(bounds)
    texts, hashes = [], []
    if len(words.hashes) >= k:
        starts = np.flatnonzero(words.text[: len(words.text) - k + 1] == words.text[k - 1 :])
        texts.append(words.text[starts])
        hashes.append(_chain(words.hashes, starts, k))
    for length in range(1, k):
        short = np.flatnonzero(n == length)
        texts.append(short)
        hashes.append(mixed(_chain(words.hashes, bounds[short], length) + np.uint64(length)))
    text, h = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[new], h[new]


def _described(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of a run, and size and class of each text's set (0 and 0 if empty)."""
    text, h = shingle_sets(words, k)
    n = np.bincount(text, minlength=words.texts)
    classes = np.zeros(words.texts, dtype=np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        firsts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        sums = np.add.reduceat(mixed(h ^ np.uint64(0xA5A5_5A5A_1234_8765)), firsts)
        classes[full] = np.maximum(mixed(sums + n[full].astype(np.uint64)), np.uint64(1))
    return text, h, n, classes


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """Length within which sets of ``percent`` similarity share a shingle."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def parity_bitmaps(text: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.Array:
    """A bit for the parity of each residue of a set's hashes, in bytes; null for sets that the short bitmap holds.

    The number of residues is the power of two from the set's size on, so that
    unlike sets differ in far more bits than similar ones may.
    """
    long = n > BITMAP
    width = np.where(long, np.minimum(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LONGEST_BITMAP), 0)
    ends = np.cumsum(width)
    on = long[text]
    t = text[on]
    place = (ends - width)[t] + (h[on] & (width[t] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(width.sum())) & 1).astype(np.uint8)
    offsets = np.concatenate([[0], ends // 8]).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(),
        len(n),
        [pa.py_buffer(np.packbits(long, bitorder="little")), pa.py_buffer(offsets), pa.py_buffer(np.packbits(odd))],
    )


def differing_bits(one: bytes, other: bytes) -> int:
    """Bits that differ between two parity bitmaps, the longer of which is folded to the length of the other."""
    x, y = sorted((np.frombuffer(one, dtype=np.uint8), np.frombuffer(other, dtype=np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(documents: DataFrame, k: int) -> DataFrame:
    """A row per document with its class, size and parity bitmaps; and each task's counts of cells."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.int64)
        names = ["id", "hash", "class", "n", *MAPS, "parity", "chunk", "counts"]
        for batch in batches:
            for low, words in word_runs(batch.column(2), BLANK_SEPARATED):
                text, h, n, classes = _described(words, k)
                counts += np.bincount(_cell(h), minlength=CELLS)
                odd = np.zeros((words.texts, BITMAP), dtype=np.uint8)
                place = text * BITMAP + (h & np.uint64(BITMAP - 1)).astype(np.int64)
                odd.ravel()[:] = np.bincount(place, minlength=words.texts * BITMAP) & 1
                maps = np.packbits(odd, axis=1).view(np.int64)
                none = pa.nulls(words.texts, pa.int64()), pa.nulls(words.texts, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, words.texts),
                        batch.column(1).slice(low, words.texts),
                        pa.array(classes.view(np.int64)),
                        pa.array(n),
                        *[pa.array(np.ascontiguousarray(maps[:, i])) for i in range(WORDS_OF_BITMAP)],
                        parity_bitmaps(text, h, n),
                        *none,
                    ],
                    names,
                )
        chunks = CELLS // CHUNK
        packed = [zlib.compress(part.tobytes(), 1) for part in counts.reshape(chunks, CHUNK)]
        none = [*[pa.nulls(chunks, pa.int64())] * (4 + len(MAPS)), pa.nulls(chunks, pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(chunks), pa.int64()), pa.array(packed)], names)

    columns = ", ".join(f"{c} bigint" for c in ("id", "hash", "class", "n", *MAPS))
    return documents.mapInArrow(releasing(scan), f"{columns}, parity binary, chunk bigint, counts binary")


def _counted(chunks: DataFrame) -> np.ndarray:
    """Sums of the tasks' counts; what reaches the driver has ``CELLS`` numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(zlib.decompress(packed), dtype=np.int64)
                sums[chunk] = sums[chunk] + counts if chunk in sums else counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())],
            ["chunk", "counts"],
        )

    summed = chunks.repartition("chunk").mapInArrow(add, "chunk bigint, counts binary").collect()
    out = np.zeros((CELLS // CHUNK, CHUNK), dtype=np.int64)
    for row in summed:
        out[row["chunk"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return out.ravel()


def _postings(documents: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """``(token, class, position)`` of the first shingles of every set, once per task and class."""
    shared = documents.sparkSession.sparkContext.broadcast(counts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in batches:
            for _, words in word_runs(batch.column(2), BLANK_SEPARATED):
                text, h, n, classes = _described(words, k)
                new = np.zeros(words.texts, dtype=bool)
                for i, c in enumerate(classes.tolist()):
                    if c and c not in seen:
                        seen.add(c)
                        new[i] = True
                keep = new[text]
                text, h = text[keep], h[keep]
                order = np.lexsort((h, counts[_cell(h)], text))
                text, h = text[order], h[order]
                size = np.where(new, n, 0)
                position = np.arange(len(text)) - (np.cumsum(size) - size)[text]
                first = position < _prefix(n, percent)[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[first].view(np.int64)),
                        pa.array(classes[text[first]].view(np.int64)),
                        pa.array(position[first].astype(np.int32)),
                    ],
                    ["token", "class", "position"],
                )

    return documents.mapInArrow(releasing(scan), "token bigint, class bigint, position int")


def _wanted_bit(c: Column) -> Column:
    return F.pmod(c, F.lit(WANTED_BITS))


def _texts(documents: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``(class, text)`` of the classes in ``pairs``, one text of each.

    A bit table of fixed size, with a bit for the classes of each residue, keeps
    most other texts from being moved.
    """
    words = (
        pairs.select(F.explode(F.array("a", "b")).alias("class"))
        .select(_wanted_bit(F.col("class")).alias("bit"))
        .groupBy(F.floor(F.col("bit") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
        .toPandas()
    )
    table = np.zeros(WANTED_BITS // 64, dtype=np.int64)
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value.view(np.uint64), set()
        for batch in batches:
            for low, words in word_runs(batch.column(2), BLANK_SEPARATED):
                classes = _described(words, k)[3]
                place = classes.view(np.int64) % WANTED_BITS
                on = (bits[place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1)
                rows = []
                for i in np.flatnonzero((on != 0) & (classes != 0)).tolist():
                    if (c := int(classes[i])) not in seen:
                        seen.add(c)
                        rows.append(i)
                if rows:
                    picked = batch.column(2).take(pa.array([low + i for i in rows]))
                    yield pa.RecordBatch.from_arrays([pa.array(classes[rows].view(np.int64)), picked], ["class", "text"])

    found = documents.mapInArrow(releasing(scan), "class bigint, text string")
    return written(found.groupBy("class").agg(F.first("text").alias("text")), "texts")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose sets reach the similarity, by their texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(texts: pa.Array) -> Iterator[list[np.ndarray]]:
            out: list[np.ndarray] = []
            for _, words in word_runs(texts, BLANK_SEPARATED):
                text, h = shingle_sets(words, k)
                out += np.split(h, np.searchsorted(text, np.arange(1, words.texts)))
            return out

        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                good = []
                for i, (x, y) in enumerate(zip(sets(batch.column(2)), sets(batch.column(3)))):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        good.append(i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(good, pa.int64())), batch.column(1).take(pa.array(good, pa.int64()))],
                    ["a", "b"],
                )

    one = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    # the texts are the larger side at any size; without the hint small tables of pairs would change the plan
    joined = pairs.join(one.hint("merge"), "a").join(other.hint("merge"), "b")
    joined = joined.select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(releasing(scan), "a bigint, b bigint")


def block_links(
    text: np.ndarray, h: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int
) -> np.ndarray:
    """Which sets of ``left`` (rows) link to which of ``right`` (columns); a set is no link of itself.

    ``(text, h)`` are the shingles of sets of sizes ``n``; shingles of one set only add to no overlap.
    """
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    on = shared[column]
    row, column = text[on], place[column[on]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), dtype=np.int64)
    for start in range(0, int(shared.sum()), STRIP):
        a, b = np.searchsorted(column, [start, start + STRIP])
        strip = np.zeros((len(n), STRIP), dtype=np.float32)
        strip[row[a:b], column[a:b] - start] = 1
        common += (strip[left] @ strip[right].T).astype(np.int64)
    linked = 100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)
    return linked & (left[:, None] != right[None, :])


def _class_links(nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``(class, linked)``: documents of other classes that each class of ``nodes`` links to.

    ``nodes`` has ``class``, ``component``, ``n`` and ``copies``.  The blocks of
    a component grow with the root of its number of sets, as does their number.
    """

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts, hashes, sizes, done = [], [], [], 0
        for _, words in word_runs(table.column("text").combine_chunks(), BLANK_SEPARATED):
            text, h = shingle_sets(words, k)
            texts.append(text + done)
            hashes.append(h)
            sizes.append(np.bincount(text, minlength=words.texts))
            done += words.texts
        block, copies, name = (table.column(c).to_numpy() for c in ("block", "copies", "class"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = block_links(
            np.concatenate(texts), np.concatenate(hashes), np.concatenate(sizes), left, right, percent
        )
        names, totals = [name[left]], [linked @ copies[right]]
        if i != j:
            names.append(name[right])
            totals.append(copies[left] @ linked)
        return pa.table({"class": np.concatenate(names), "linked": np.concatenate(totals).astype(np.int64)})

    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    cut = F.when(F.col("sets") > BLOCK_SETS, F.sqrt("sets") / 4).otherwise(1)
    sizes = sizes.select("component", F.ceil(F.greatest(cut, F.col("shingles") / BLOCK_SHINGLES)).alias("blocks"))
    placed = nodes.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
    placed = placed.select("class", "component", "copies", "block", "blocks")
    dealt = (
        placed.join(texts.hint("merge"), "class")
        .withColumn("partner", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select(
            "component",
            F.least("block", "partner").alias("i"),
            F.greatest("block", "partner").alias("j"),
            "block",
            "class",
            "copies",
            "text",
        )
    )
    counted = dealt.groupBy("component", "i", "j").applyInArrow(count, "class bigint, linked bigint")
    return counted.groupBy("class").agg(F.sum("linked").alias("linked"))


def _required(percent: int) -> Column:
    """Least overlap with which sets of sizes n_a and n_b reach the similarity."""
    return F.expr(f"({percent} * (n_a + n_b) + {100 + percent - 1}) div {100 + percent}")


def _may_link(percent: int) -> Column:
    """What sizes and parity bitmaps allow: every differing bit is a shingle of one set only."""
    sizes = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    differing = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MAPS), F.lit(0))
    return sizes & (differing + 2 * _required(percent) <= F.col("n_a") + F.col("n_b"))


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose long parity bitmaps allow the similarity.

    Short bitmaps fill up with long sets and tell nothing of these, whose texts
    would be most of what is moved.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False) + batch.column(3).to_numpy(zero_copy_only=False)
            most = n - 2 * ((percent * n + 100 + percent - 1) // (100 + percent))
            good = [
                i
                for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()))
                if x is None or y is None or differing_bits(x, y) <= most[i]
            ]
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    bitmaps = classes.select("class", "n", "parity")
    one, other = (_side(bitmaps.withColumnRenamed("class", s), s, s) for s in ("a", "b"))
    joined = pairs.join(one, "a").join(other, "b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b")
    return joined.mapInArrow(scan, "a bigint, b bigint")


def _side(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.select(*columns, *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in columns])


def join_components(
    documents: DataFrame,
    k: int = 5,
    percent: int = 80,
    text: str = "text",
    doc_id: str = "doc_id",
    links: bool = True,
) -> DataFrame:
    """``(id, hash, n_shingles, component, component_id, class, n_links)`` of every row of ``documents``.

    ``id`` is the document's id (the smallest long for null) and ``hash`` the
    ``xxhash64`` of its text (that of the empty one for null).  Words are A-Z
    lower-cased and stand between ASCII white space; two documents link when
    ``100 * common >= percent * union`` of their distinct ``k``-word shingles.
    ``component`` stands for what is linked, and ``component_id`` is the smallest
    id in it; a document without words is alone and has no ``component``.  Rows of
    equal sets have one ``class`` (0 without words), and ``n_links`` is how many
    other rows a row links to, those of its own class among them; without
    ``links`` it is left out and not computed.  Equal rows give equal rows; an
    empty table gives none.
    """
    slim = documents.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    scanned = written(_sets(slim, k), "sets")
    sets = scanned.where("chunk is null").drop("chunk", "counts")
    counts = _counted(scanned.where("chunk is not null").select("chunk", "counts"))

    classes = written(
        sets.where("n > 0").groupBy("class").agg(
            F.max("n").alias("n"),
            F.min(F.nullif("id", F.lit(NO_ID))).alias("least_id"),
            F.count(F.lit(1)).alias("copies"),
            *[F.max(m).alias(m) for m in MAPS],
            F.max("parity").alias("parity"),
        ),
        "classes",
    )
    postings = written(_postings(slim, counts, k, percent), "postings")
    # lists of one class end here
    shared = postings.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    lists = written(postings.join(shared, "token"), "lists")

    about = classes.drop("least_id", "copies", "parity")
    near = (
        lists.select("class", F.explode(F.array("low", "high")).alias("other"))
        .where("class <> other")
        .select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"))
        .distinct()
    )
    one, other = (_side(about.withColumnRenamed("class", s), s, s) for s in ("a", "b"))
    near = written(near.join(one, "a").join(other, "b").where(_may_link(percent)).select("a", "b"), "pairs")
    alike = written(_alike(near, classes, percent), "alike")
    texts = _texts(slim, alike, k)
    found = written(_linked(alike, texts, k, percent), "links")
    joined = components(found)

    # lists with sets of different components: the smaller set of a pair has the token in its first block
    member = lists.select("token", "class", "position").join(
        joined.withColumnRenamed("node", "class"), "class", "left"
    ).withColumn("component", F.coalesce("component", "class"))
    member = written(member, "members")
    mixed_lists = (
        member.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    )
    member = member.join(mixed_lists.select("token"), "token").join(about, "class")
    first_block = F.expr(f"position <= n - ({2 * percent} * n + {100 + percent - 1}) div {100 + percent}")
    smaller = _side(member.where(first_block), "a", "token")
    larger = _side(member, "b", "token")
    overlap = F.expr("1 + least(position_a, position_b) + least(n_a - position_a, n_b - position_b) - 1")
    rest = (
        smaller.join(larger, "token")
        .where("component_a <> component_b and (n_a < n_b or n_a = n_b and class_a < class_b)")
        .where(_may_link(percent) & (overlap >= _required(percent)))
        .select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))
        .distinct()
        .join(near, ["a", "b"], "left_anti")
    )
    rest = written(_alike(rest, classes, percent), "alike")
    other_texts = _texts(slim, rest, k)
    more = _linked(rest, other_texts, k, percent)
    joined = components(written(found.union(more), "links"))

    whole = classes.select("class", "least_id", "copies").join(joined.withColumnRenamed("node", "class"), "class", "left")
    whole = whole.withColumn("component", F.coalesce("component", "class"))
    least = whole.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = whole.join(least, "component").select("class", "component", "component_id", "copies")
    columns = [
        "id",
        "hash",
        F.col("n").alias("n_shingles"),
        "component",
        # the least real id; null where no member has one
        F.nullif(F.coalesce("component_id", "id"), F.lit(NO_ID)).alias("component_id"),
    ]
    if links:
        nodes = joined.withColumnRenamed("node", "class").join(classes.select("class", "n", "copies"), "class")
        # both hold a text of each class that has a link
        every_text = texts.union(other_texts.join(texts.select("class"), "class", "left_anti"))
        of_class = of_class.join(written(_class_links(nodes, every_text, k, percent), "linked"), "class", "left")
        n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0))
        columns += ["class", n_links.alias("n_links")]
    return sets.join(of_class, "class", "left").select(*columns)


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component, that of the smallest id, and all without words.

    Among texts of the same smallest id, that of the smallest hash stays; of
    rows that agree in id and text, one.
    """
    found = join_components(documents, k, percent, text, doc_id, links=False)
    first = found.where(F.col("component").isNotNull() & (F.col("id") == F.coalesce("component_id", F.lit(NO_ID))))
    kept = (
        first.groupBy("component", "id")
        .agg(F.min("hash").alias("hash"))
        .select("id", "hash")
        .union(found.where("component is null").select("id", "hash").distinct())
    )
    own_id, own_hash = fresh(documents, "join_id", "join_hash")
    rows = documents.withColumns(
        {
            own_id: F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)),
            own_hash: F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        }
    )
    kept = kept.withColumnsRenamed({"id": own_id, "hash": own_hash})
    one = rows.join(kept, [own_id, own_hash], "left_semi").dropDuplicates([own_id, own_hash])
    return one.drop(own_id, own_hash)


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = join_components(document_table(spark, folder), k=3, percent=90)
    return found.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", "component_id", "n_links")
