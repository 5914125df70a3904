"""Language-model scores by Katz backoff.

An n-gram met in training keeps its relative frequency, discounted after
Good-Turing where it is rare; the mass that this frees in a context goes to the
next shorter n-gram, by a weight that makes the context's probabilities add up
to one.  Words never met share the mass freed among single words.

Texts are coded once into blocks of some million tokens: a dictionary of word
hashes and the tokens as numbers in it.  Tables of n-grams and contexts are
partitioned by hash.  A block asks each partition once for all its distinct
n-grams and gets their counts, then asks for the totals and backoff weights of
its contexts, one order after the other, and then evaluates its tokens from the
shortest order up.  So no key is sent more often than there are blocks that hold
it, however frequent it is, and no table is gathered anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.llm.common import document_table, fold, new_folder, written
from tidemark.llm.wordhash import BASE, BLANK_SEPARATED, mixed, word_runs

#: Tokens coded together, about; a longer text is a block of its own.
BLOCK_TOKENS = 1_000_000
#: Tokens of the corpus for each partition of the n-gram tables.
PARTITION_TOKENS = 1_000_000
#: Counts up to this one are discounted.
DISCOUNTED = 5
END, START = np.uint64(1), np.uint64(2)
RESULTS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


# --- numbers as bytes -----------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Non-negative numbers, seven bits a byte, the last byte of each below 128."""
    values = values.astype(np.uint64)
    length = np.ones(len(values), np.int64)
    for k in range(1, 10):
        length += values >= np.uint64(1 << (7 * k))
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    for k in range(int(length.max(initial=0))):
        some = length > k
        part = (values[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[start[some] + k] = part.astype(np.uint8) | np.where(length[some] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - start).max(initial=-1)) + 1):
        some = ends - start >= k
        out[some] |= (raw[start[some] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def packed_keys(keys: np.ndarray, base: int) -> bytes:
    """Ascending keys from ``base`` on: the width in bytes of their differences, and these."""
    steps = np.diff(keys, prepend=np.uint64(base))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_keys(data: bytes, base: int) -> np.ndarray:
    steps = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    steps[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    return np.uint64(base) + np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


# --- blocks -----------------------------------------------------------------------


class Block:
    """The n-grams of a block's tokens, and which end with which shorter one.

    Before each document stand ``order - 1`` start signs, after it an end sign.
    With ``keys_only`` nothing but the n-grams and their counts is kept.
    """

    def __init__(
        self,
        words: np.ndarray,
        codes: np.ndarray,
        lengths: np.ndarray,
        learn: np.ndarray,
        order: int,
        keys_only: bool = False,
    ):
        self.lengths = lengths + 1  # with the end sign
        pad = order - 1
        starts = np.cumsum(self.lengths + pad) - (self.lengths + pad)
        places = np.arange(len(codes)) + np.repeat(starts + pad, lengths) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tokens = np.full(int((self.lengths + pad).sum()), START)
        tokens[places] = words[codes]
        tokens[starts + pad + lengths] = END
        real = np.ones(len(tokens), bool)
        for k in range(pad):
            real[starts + k] = False
        real = np.flatnonzero(real)
        weight = np.repeat(learn, self.lengths)
        self.keys, self.inverse, self.counts, self.contexts, self.context, self.shorter = [], [], [], [], [], []
        ending = tokens
        for level in range(order):
            before = ending
            if level:
                ending = np.zeros_like(tokens)
                ending[1:] = mixed(before[:-1] * BASE + tokens[1:])
            keys, first, inverse = np.unique(ending[real], return_index=True, return_inverse=True)
            inverse = inverse.astype(np.int32)
            self.keys.append(keys)
            self.counts.append(np.bincount(inverse, weights=weight, minlength=len(keys)).astype(np.int64))
            if keys_only:
                continue
            self.inverse.append(inverse)
            if level:
                contexts, context = np.unique(before[real[first] - 1], return_inverse=True)
                self.contexts.append(contexts)
                self.context.append(context)
                self.shorter.append(self.inverse[level - 1][first])
            else:
                self.contexts.append(None)
                self.context.append(None)
                self.shorter.append(None)


def _coded_schema(kept: T.StructType) -> T.StructType:
    kinds = {"block": T.LongType(), "kept": T.ArrayType(kept), "n_tokens": T.LongType()}
    kinds |= {c: T.BinaryType() for c in ("learn", "lengths", "codes", "words")}
    return T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])


def coded_blocks(df: DataFrame, learn: Column, text: str, block_tokens: int) -> DataFrame:
    """A row for each block: its documents' other columns, whether each is learnt from, and its coded tokens.

    Words get numbers by falling frequency in the block, so that most take one byte.
    """
    kept = [c for c in df.columns if c != text]
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]) if kept else F.struct(F.lit(0).alias("c0"))
    rows = df.select(row.alias("kept"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    schema = _coded_schema(rows.schema["kept"].dataType)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, documents, learnt, hashes, lengths, size = TaskContext.get().partitionId() << 33, [], [], [], [], 0

        def block() -> pa.RecordBatch:
            whole = np.concatenate(hashes)
            words, codes, times = np.unique(whole, return_inverse=True, return_counts=True)
            falling = np.argsort(-times, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[falling] = np.arange(len(words))
            structs = pa.concat_arrays(documents)
            kept_list = pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs)
            data = {
                "learn": np.concatenate(learnt).astype(np.uint8).tobytes(),
                "lengths": packed(np.concatenate(lengths)),
                "codes": packed(rank[codes]),
                "words": words[falling].tobytes(),
            }
            columns = [pa.array([number]), kept_list, pa.array([len(whole)]), *[pa.array([d], pa.binary()) for d in data.values()]]
            return pa.RecordBatch.from_arrays(columns, ["block", "kept", "n_tokens", *data])

        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False)
            for low, words in word_runs(batch.column(2), BLANK_SEPARATED):
                documents.append(batch.column(0).slice(low, words.texts))
                learnt.append(flags[low : low + words.texts])
                hashes.append(words.hashes)
                lengths.append(np.diff(words.bounds()))
                size += len(words.hashes)
                if size >= block_tokens:
                    yield block()
                    number, documents, learnt, hashes, lengths, size = number + 1, [], [], [], [], 0
        if documents:
            yield block()

    return rows.mapInArrow(code, schema)


def _decoded(row: dict, order: int, keys_only: bool = False) -> Block:
    return Block(
        np.frombuffer(row["words"], np.uint64),
        unpacked(row["codes"]),
        unpacked(row["lengths"]),
        np.frombuffer(row["learn"], np.uint8),
        order,
        keys_only,
    )


# --- asking the partitioned tables ----------------------------------------------------

REQUEST = "level int, part bigint, block bigint, keys binary, a binary, b binary, c binary"
ANSWER = "block bigint, level int, kind string, part bigint, a binary, b binary, stats array<bigint>"


def requests(level: int, block: int, keys: np.ndarray, bits: int, *values: np.ndarray) -> pa.RecordBatch:
    """A block's ascending keys with their values, cut at the partitions' bounds."""
    width = 64 - bits
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width)).tolist()
    found: dict[str, list] = {c: [] for c in ("part", "keys", "a", "b", "c")}
    for part, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(keys)])):
        if low < high:
            found["part"].append(part)
            found["keys"].append(packed_keys(keys[low:high], part << width))
            for name, value in zip("abc", values):
                some = value[low:high]
                found[name].append(packed(some) if some.dtype == np.int64 else some.tobytes())
            for name in "abc"[len(values) :]:
                found[name].append(None)
    n = len(found["part"])
    columns = [pa.array([level] * n, pa.int32()), pa.array(found["part"], pa.int64()), pa.array([block] * n, pa.int64())]
    columns += [pa.array(found[c], pa.binary()) for c in ("keys", "a", "b", "c")]
    return pa.RecordBatch.from_arrays(columns, ["level", "part", "block", "keys", "a", "b", "c"])


def _merged(group: pa.Table, bits: int) -> tuple[list[dict], list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Requests of one partition by block, the bounds of each, the distinct keys, which one each is, and who was first."""
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    lists = [unpacked_keys(r["keys"], r["part"] << (64 - bits)) for r in rows]
    bounds = np.cumsum([0, *map(len, lists)]).tolist()
    keys, first, inverse = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
    return rows, bounds, keys, inverse, first


def _answers(rows: list[dict], kind: str, bounds: list[int], a: np.ndarray, b: np.ndarray) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in ("block", "level", "kind", "part", "a", "b", "stats")}
    for row, low, high in zip(rows, bounds, bounds[1:]):
        first = a[low:high]
        values = (row["block"], row["level"], kind, row["part"])
        values += (packed(first) if first.dtype == np.int64 else first.tobytes(), b[low:high].tobytes(), None)
        for column, value in zip(out, values):
            out[column].append(value)
    return out


def _table(out: dict[str, list]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def counted(asked: DataFrame, bits: int) -> DataFrame:
    """Answers of kind ``counts``: the corpus count of each key asked for, and whether the block owns it.

    The first block that a learnt n-gram stands in owns it, and adds it to its
    context once.  A row of kind ``stats`` for each partition has the number of
    distinct n-grams, their total, and how many stand once, twice and so on.
    """

    def count(group: pa.Table) -> pa.Table:
        rows, bounds, keys, inverse, _ = _merged(group, bits)
        own = np.concatenate([unpacked(r["a"]) for r in rows])
        total = np.bincount(inverse, weights=own, minlength=len(keys)).astype(np.int64)
        # blocks are in order, so the first entry with a count is the owner's
        held = np.flatnonzero(own)
        owner = np.zeros(len(inverse), np.uint8)
        owner[held[np.unique(inverse[held], return_index=True)[1]]] = 1
        out = _answers(rows, "counts", bounds, total[inverse], owner)
        times = [int((total == r).sum()) for r in range(1, DISCOUNTED + 2)]
        stats = [int((total > 0).sum()), int(total.sum()), *times]
        last = (-1, rows[0]["level"], "stats", rows[0]["part"], None, None, stats)
        for column, value in zip(out, last):
            out[column].append(value)
        return _table(out)

    return asked.groupBy("level", "part").applyInArrow(count, ANSWER)


def weighed(asked: DataFrame, bits: int) -> DataFrame:
    """Answers of kind ``weights``: the divisor and the backoff weight of each context asked for.

    The divisor is the context's count, or one more where no n-gram of it is
    discounted, so that some mass is always left.  The weight is that mass by
    what the shorter n-grams give to words not met in the context; an unknown
    context has divisor 0 and weight 1.
    """

    def weigh(group: pa.Table) -> pa.Table:
        rows, bounds, keys, inverse, _ = _merged(group, bits)
        total = np.bincount(inverse, weights=np.concatenate([unpacked(r["a"]) for r in rows]), minlength=len(keys))
        freed, shorter = (
            np.bincount(inverse, weights=np.concatenate([np.frombuffer(r[c]) for r in rows]), minlength=len(keys))
            for c in "bc"
        )
        full = (total > 0) & (freed <= 0)
        divisor = total + full
        left = np.where(full, 1.0, freed) / np.maximum(divisor, 1)
        weight = np.where(total > 0, left / np.maximum(1 - shorter, 1e-300), 1.0)
        return _table(_answers(rows, "weights", bounds, divisor[inverse], weight[inverse]))

    return asked.groupBy("level", "part").applyInArrow(weigh, ANSWER)


# --- discounts ------------------------------------------------------------------------


def good_turing(times: np.ndarray) -> np.ndarray:
    """Factors for counts 1 to ``DISCOUNTED``, from how many n-grams stand 1 to ``DISCOUNTED + 1`` times.

    Katz's: Turing's estimate less the share ``(k + 1) n_{k + 1} / n_1`` that
    makes counts above ``k`` keep their frequency.  Where the numbers are too
    uneven for factors between 0 and 1 they are smoothed by a line through their
    logarithms, and where that fails too half an occurrence is taken off each.
    """
    r = np.arange(1, DISCOUNTED + 1)
    half = 1 - 0.5 / r

    def factors(n: np.ndarray) -> np.ndarray | None:
        with np.errstate(divide="ignore", invalid="ignore"):
            common = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0]
            d = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
        return d if np.isfinite(d).all() and (d > 0).all() and (d < 1).all() else None

    times = np.asarray(times, float)
    found = factors(times)
    seen = np.flatnonzero(times)
    if found is None and len(seen) > 1:
        slope, level = np.polyfit(np.log(seen + 1), np.log(times[seen]), 1)
        found = factors(np.exp(level + slope * np.log(np.arange(1, DISCOUNTED + 2))))
    return half if found is None else found


class Discounts:
    """Factors of every order, and the single words' totals."""

    def __init__(self, stats: dict[int, np.ndarray], order: int):
        none = np.zeros(DISCOUNTED + 3, np.int64)
        self.factors = [good_turing(stats.get(level, none)[2:]) for level in range(order)]
        self.distinct, self.tokens = (int(v) for v in stats.get(0, none)[:2])
        freed = float(((1 - self.factors[0]) * np.arange(1, DISCOUNTED + 1)) @ stats.get(0, none)[2:-1])
        # the mass of all words never met; with nothing freed, one occurrence is set aside
        self.words = self.tokens + (freed <= 0)
        self.unknown = (freed if freed > 0 else 1.0) / self.words

    def discounted(self, level: int, counts: np.ndarray) -> np.ndarray:
        low = np.clip(counts, 1, DISCOUNTED)
        return np.where(counts <= DISCOUNTED, self.factors[level][low - 1], 1.0) * counts

    def single(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of single words; each word never met has that of all of them."""
        return np.where(counts > 0, self.discounted(0, counts) / self.words, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


class Answered:
    """What a block has been told, by level."""

    def __init__(self, answers: list[dict]):
        self.counts, self.owned, self.divisors, self.weights = {}, {}, {}, {}
        by: dict[tuple[str, int], list[dict]] = {}
        for answer in sorted(answers, key=lambda a: a["part"]):
            by.setdefault((answer["kind"], answer["level"]), []).append(answer)
        for (kind, level), parts in by.items():
            if kind == "counts":
                self.counts[level] = np.concatenate([unpacked(p["a"]) for p in parts])
                self.owned[level] = np.concatenate([np.frombuffer(p["b"], np.uint8) for p in parts])
            else:
                self.divisors[level] = np.concatenate([np.frombuffer(p["a"]) for p in parts])
                self.weights[level] = np.concatenate([np.frombuffer(p["b"]) for p in parts])

    def probabilities(self, block: Block, level: int, model: Discounts) -> np.ndarray:
        """Of the block's distinct n-grams of a level, from the shorter ones up."""
        counts = self.counts[level]
        if not level:
            return model.single(counts)
        shorter = self.probabilities(block, level - 1, model)[block.shorter[level]]
        context = block.context[level]
        met = model.discounted(level, counts) / np.maximum(self.divisors[level][context], 1)
        return np.where(counts > 0, met, self.weights[level][context] * shorter)


def _weights_asker(level: int, order: int, bits: int, model: Discounts):
    """Asks for the contexts of a block's n-grams of a level, and tells what those that it owns take and free."""

    def ask(block_rows: pa.Table, told: pa.Table) -> pa.Table:
        (row,) = block_rows.to_pylist()
        block, known = _decoded(row, order), Answered(told.to_pylist())
        own = known.owned[level] > 0
        context, n = block.context[level][own], len(block.contexts[level])
        count = known.counts[level][own]
        shorter = known.probabilities(block, level - 1, model)[block.shorter[level][own]]
        total = np.bincount(context, weights=count, minlength=n).astype(np.int64)
        # only discounted counts free mass, so that a context without any frees exactly none
        freed = np.where(count <= DISCOUNTED, count - model.discounted(level, count), 0.0)
        values = [np.bincount(context, weights=w, minlength=n).astype(float) for w in (freed, shorter)]
        return pa.Table.from_batches([requests(level, row["block"], block.contexts[level], bits, total, *values)])

    return ask


# --- the operator ---------------------------------------------------------------------


def katz_scores(
    df: DataFrame,
    learn: Column,
    text: str = "text",
    order: int = 2,
    block_tokens: int = BLOCK_TOKENS,
    partition_tokens: int = PARTITION_TOKENS,
) -> DataFrame:
    """``df`` without its text, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    The model of ``order`` learns from the rows where ``learn`` holds, and all
    rows are scored.  Tokens are the words of the text, A-Z lower-cased, and an
    end sign; a null or empty text is the end sign alone.  ``score`` is the log10
    probability of the text, ``base_score`` that of single words with half an
    occurrence added to each; ``n_known`` counts tokens met in training.  With
    nothing to learn from, every score is 0.  Columns of these names are
    replaced.
    """
    spark = df.sparkSession
    rows = df.drop(*[c for c in RESULTS if c != text])
    kept = [c for c in rows.columns if c != text and c.lower() not in RESULTS]
    plan = coded_blocks(rows, learn, text, block_tokens)
    # bucketed by block, so that later rounds bring answers to the blocks and not blocks to the answers
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"katz_{uuid.uuid4().hex}"
    path = new_folder(spark, "katz-blocks")
    plan.write.bucketBy(buckets, "block").sortBy("block").option("path", path).option("compression", "zstd").saveAsTable(name)
    blocks = spark.table(name)
    tokens = blocks.agg(F.sum("n_tokens")).first()[0]
    bits = max(3, (max(1, tokens or 0) // partition_tokens).bit_length())
    spent = ["learn", "lengths", "codes", "words"]

    def ask_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                block = _decoded(row, order, keys_only=True)
                for level in range(order):
                    yield requests(level, row["block"], block.keys[level], bits, block.counts[level])

    asked = blocks.select("block", *spent).mapInArrow(ask_counts, REQUEST)
    counts = written(counted(asked, bits), "katz-counts")
    stats = (
        counts.where("kind = 'stats'")
        .select("level", F.posexplode("stats").alias("place", "n"))
        .groupBy("level", "place")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    totals: dict[int, np.ndarray] = {}
    for row in stats:
        totals.setdefault(row["level"], np.zeros(DISCOUNTED + 3, np.int64))[row["place"]] = row["n"]
    model = Discounts(totals, order)
    answers = counts.where("kind = 'counts'").drop("stats")

    for level in range(1, order):
        told = blocks.select("block", *spent).groupBy("block").cogroup(answers.groupBy("block"))
        asked = told.applyInArrow(_weights_asker(level, order, bits, model), REQUEST)
        answers = answers.union(written(weighed(asked, bits), "katz-weights").drop("stats"))

    schema = T.StructType(
        [
            T.StructField("kept", blocks.schema["kept"].dataType.elementType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def evaluate(block_rows: pa.Table, told: pa.Table) -> pa.Table:
        documents = block_rows["kept"].combine_chunks().flatten()
        (row,) = block_rows.select(["block", *spent]).to_pylist()
        block, known = _decoded(row, order), Answered(told.to_pylist())
        first = np.cumsum(block.lengths) - block.lengths
        single = known.counts[0][block.inverse[0]]
        top = np.log10(known.probabilities(block, order - 1, model))[block.inverse[order - 1]]
        columns = [block.lengths, np.add.reduceat((single > 0).astype(np.int64), first)]
        columns += [np.add.reduceat(model.base(single), first), np.add.reduceat(top, first)]
        return pa.Table.from_arrays([documents, *map(pa.array, columns)], names=schema.names)

    scored = blocks.select("block", "kept", *spent).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(evaluate, schema)
    names = [c for c in rows.columns if c != text]
    return scored.select(
        *[F.col("kept")[f"c{names.index(c)}"].alias(c) for c in kept],
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def held_out(doc_id: Column) -> Column:
    """Whether a document is not learnt from; one without an id is."""
    return F.coalesce(fold(doc_id, 5) == 1, F.lit(False))


def op12_katz(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a bigram model of those that are not held out."""
    documents = document_table(spark, folder).select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return katz_scores(documents, ~F.col("held_out")).select("doc_id", "held_out", *RESULTS)
