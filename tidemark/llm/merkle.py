"""A Merkle manifest of a table: a tree of leaves in each group, and a tree of the groups.

Nodes of one tree are appended in order, in aligned blocks of ``FANOUT ** 3``.
Each open subtree of a block keeps the partial witnesses of what was appended to
it; when a later sibling completes, the witnesses grow by it.  A block's root is
appended like a leaf to the tree above, and so on until one node remains, so a
block is the largest thing that a task holds.  On the way back the witness of a
block extends those of its members up to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import LOWER, UPPER, ascii_lower, document_table, fold, written

#: Nodes of a run, whose digests are hashed together.
FANOUT = 16
#: Nodes appended by one task to one tree, a power of ``FANOUT``.
BLOCK = FANOUT**3
#: Witnesses sent back together; each has some kilobytes.
ROWS_AT_ONCE = 1_000
WITNESS = "array<struct<left:string,right:string>>"
_WITNESS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the framed values."""
    return F.sha2(F.concat(*[framed(v) for v in values]).cast("binary"), 256)


def joined_digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Appended:
    """Nodes appended in order to the subtrees that are open.

    ``open[level]`` is the run that waits at a level: the digests of its nodes
    and, for each, the numbers of the appended nodes below it.  Completing a run
    extends the witness of everything below by the node's siblings.
    """

    def __init__(self, witnesses: bool):
        self.open: list[tuple[list[str], list[range]]] = []
        self.witness: list[list[tuple[str, str]]] | None = [] if witnesses else None
        self.size = 0

    def append(self, digest: str) -> None:
        if self.witness is not None:
            self.witness.append([])
        self._put(0, digest, range(self.size, self.size + 1))
        self.size += 1

    def _put(self, level: int, digest: str, below: range) -> None:
        if level == len(self.open):
            self.open.append(([], []))
        digests, members = self.open[level]
        digests.append(digest)
        members.append(below)
        if len(digests) == FANOUT:
            self._complete(level)

    def _complete(self, level: int) -> None:
        digests, members = self.open[level]
        self.open[level] = ([], [])
        run = "".join(digests)
        if self.witness is not None:
            width = len(digests[0])
            for i, below in enumerate(members):
                step = (run[: i * width], run[(i + 1) * width :])
                for leaf in below:
                    self.witness[leaf].append(step)
        self._put(level + 1, joined_digest(digests), range(members[0].start, members[-1].stop))

    def finish(self, levels: int | None = None) -> str:
        """The root: after so many levels, or, if none are given, of the whole tree.

        Open runs are completed from below, even those of one node.
        """
        level = 0
        while True:
            above = any(digests for digests, _ in self.open[level + 1 :])
            digests = self.open[level][0] if level < len(self.open) else []
            if not above and len(digests) == 1 and level >= (levels or 0):
                return digests[0]
            if digests:
                self._complete(level)
            level += 1


def _levels(block: int) -> int:
    levels = 0
    while FANOUT**levels < block:
        levels += 1
    return levels


def _appended(group: pa.Table, block: int, witnesses: bool) -> tuple[pa.Table, Appended, str]:
    """The group by position, its nodes appended, and their root.

    A tree of several blocks takes all of them up by the same number of levels.
    """
    group = group.sort_by("position")
    nodes = Appended(witnesses)
    for digest in group["digest"].to_pylist():
        nodes.append(digest)
    return group, nodes, nodes.finish(_levels(block) if group["more"][0].as_py() else None)


def block_roots(nodes: DataFrame, block: int) -> DataFrame:
    """``tree, block, more, digest``: the root of each block of each tree."""

    def reduce(group: pa.Table) -> pa.Table:
        group, _, root = _appended(group, block, False)
        return group.select(["tree", "block", "more"]).slice(0, 1).append_column("digest", pa.array([root]))

    return nodes.select("tree", "block", "more", "position", "digest").groupBy("tree", "block").applyInArrow(
        reduce, "tree string, block bigint, more boolean, digest string"
    )


def extended(nodes: DataFrame, above: DataFrame, block: int) -> DataFrame:
    """``nodes`` with ``subroot``, ``root`` and ``witness`` up to the root.

    ``above`` has these of each ``(tree, block)``.
    """
    kept = [f"{c} {t}" for c, t in nodes.dtypes]
    # columns of their own, since both sides may come from one table
    above = above.select(*[F.col(c).alias(c) for c in ("tree", "block", "subroot", "root", "witness")])

    def extend(group: pa.Table, block_above: pa.Table) -> Iterator[pa.RecordBatch]:
        group, appended, _ = _appended(group, block, True)
        (top,) = block_above.select(["subroot", "root", "witness"]).to_pylist()
        upper = [(step["left"], step["right"]) for step in top["witness"]]
        names = [*group.column_names, "subroot", "root", "witness"]
        for start in range(0, len(group), ROWS_AT_ONCE):
            part = group.slice(start, ROWS_AT_ONCE).combine_chunks()
            steps = [
                [{"left": left, "right": right} for left, right in appended.witness[i] + upper]
                for i in range(start, start + len(part))
            ]
            tops = [pa.array([top[c]] * len(part), pa.string()) for c in ("subroot", "root")]
            columns = [*part.columns, *tops, pa.array(steps, _WITNESS)]
            yield from pa.Table.from_arrays(columns, names=names).to_batches()

    def whole(group: pa.Table, block_above: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(extend(group, block_above)))

    return (
        nodes.groupBy("tree", "block")
        .cogroup(above.groupBy("tree", "block"))
        .applyInArrow(whole, ", ".join([*kept, "subroot string", "root string", f"witness {WITNESS}"]))
    )


def positioned(nodes: DataFrame, order: Sequence[str], block: int) -> DataFrame:
    """``nodes`` (tree, digest, ...) with their ``position`` in the tree, ``block``, and whether it has ``more`` blocks.

    Rows are range-partitioned by tree and ``order``, so a tree with a third of
    all rows spreads over many tasks; what one has in the partitions before is
    added from a table of one row per tree and partition.
    """
    ranged = written(
        nodes.repartitionByRange("tree", *order)
        .sortWithinPartitions("tree", *order)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.expr("shiftright(at, 33)")),
        "merkle-order",
    )
    in_tree = Window.partitionBy("tree")
    before = in_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("tree", "part")
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .select(
            "tree",
            "part",
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
            (F.sum("n").over(in_tree) > block).alias("more"),
        )
    )
    return written(
        ranged.join(starts, ["tree", "part"])
        .withColumn("position", F.col("at") + F.col("shift"))
        .withColumn("block", F.floor(F.col("position") / block))
        .drop("at", "part", "shift"),
        "merkle-nodes",
    )


def _rounds(nodes: DataFrame, block: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of every round, and ``tree, digest`` of the trees' roots.

    Each round has ``block`` times fewer nodes than the one before.
    """
    rounds, done = [nodes], []
    while True:
        roots = written(block_roots(rounds[-1], block), "merkle-roots")
        done.append(roots.where("not more").select("tree", "digest"))
        if roots.where("more").isEmpty():
            break
        nodes = roots.where("more").select("tree", "digest", F.col("block").alias("position"))
        larger = nodes.groupBy("tree").agg((F.count(F.lit(1)) > block).alias("more"))
        nodes = nodes.join(larger, "tree").withColumn("block", F.floor(F.col("position") / block))
        rounds.append(written(nodes, "merkle-nodes"))
    roots = done[0]
    for part in done[1:]:
        roots = roots.union(part)
    return rounds, roots


def _descended(rounds: Sequence[DataFrame], tops: DataFrame, block: int) -> DataFrame:
    """The first round's nodes with their witnesses; ``tops`` has those of each tree's root."""
    tops = tops.select("tree", F.lit(0).cast("long").alias("block"), "subroot", "root", "witness")
    above = None
    for nodes in reversed(rounds):
        # a tree whose last round this is hangs from its root, another block from a node of the round above
        ending = nodes.where("not more").select("tree").distinct().join(tops, "tree").select(*tops.columns)
        over = ending if above is None else ending.union(above)
        reached = extended(nodes, over, block)
        if nodes is rounds[0]:
            return reached
        above = written(
            reached.select("tree", F.col("position").alias("block"), "subroot", "root", "witness"), "merkle-witnesses"
        )
    raise ValueError("no round")


def manifest(leaves: DataFrame, group: str, order: Sequence[str], leaf: str, block: int = BLOCK) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``witness`` of each row's digest in column ``leaf``.

    Groups are trees of their rows in ascending ``order`` (null first; rows that
    agree in all of it and in the digest may change places), with ``subroot`` at
    the top; subroots in ascending order of ``group``, null first, make the tree
    of ``root``.  ``witness`` lists, from the leaf to the root, the digests left
    and right of the path at each level.  ``group`` is compared as text.
    Columns of these names are replaced.  A table without rows gives none.
    """
    rows = leaves.drop("subroot", "root", "witness")
    keyed = rows.select(
        # sorts as the group does, with null before the empty text
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(leaf).alias("digest"),
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rows.columns)]).alias("row"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
    )
    # digests are computed once; the row number spreads rows that agree in all else
    keyed = written(keyed, "merkle-leaves").withColumn("o", F.monotonically_increasing_id())
    by = [*[f"o{i}" for i in range(len(order))], "digest", "o"]
    rounds, subroots = _rounds(positioned(keyed, by, block).drop(*[c for c in by if c != "digest"]), block)
    groups = subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("group"))
    group_rounds, root = _rounds(positioned(groups, ["group"], block), block)
    top = root.select(
        "tree", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast(WITNESS).alias("witness")
    )
    tops = _descended(group_rounds, top, block).select(
        F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", "witness"
    )
    found = _descended(rounds, written(tops, "merkle-witnesses"), block)
    return found.select(
        *[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(rows.columns)], "subroot", "root", "witness"
    )


def folded(digest: Column, witness: Column) -> Column:
    """The root that a digest and a witness lead to."""
    return F.aggregate(
        witness, digest, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]).cast("binary"), 256)
    )


def proof_digest(witness: Column) -> Column:
    """SHA-256 of all siblings of a witness, from the leaf to the root."""
    siblings = F.transform(witness, lambda step: F.concat(step["left"], step["right"]))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of ``documents`` by source, checked against a table that was tampered with.

    Tampering lower-cases A-Z of the texts whose id's CRC-32 is divisible by 5;
    rows without an id or a text are left as they are.  Repeated rows are leaves
    of their own.
    """
    documents = document_table(spark, folder).select(*FIELDS)
    tampered = F.when(fold(F.col("doc_id"), 5) == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    leaves = documents.select(
        "doc_id",
        "source",
        leaf_digest([F.col(c) for c in FIELDS]).alias("leaf"),
        leaf_digest([F.col(c) for c in FIELDS[:-1]] + [tampered]).alias("now"),
    )
    found = manifest(leaves, "source", ["doc_id"], "leaf").withColumn(
        "folded_root", folded(F.col("now"), F.col("witness"))
    )
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("witness")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _oracle(levels: int = 7) -> str:
    """The same by window functions, for up to ``FANOUT ** levels`` leaves a source or sources."""

    def frame(c: str, value: str | None = None) -> str:
        text = f"CAST({value or c} AS VARCHAR)"
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"

    def crc32(text: str) -> str:
        bits = "list_reduce(list_concat([{0}], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
        codes = f"list_transform(string_split({text}, ''), lambda d: CAST(ascii(d) AS BIGINT))"
        return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, d: {bits.format('xor(c, d)')}), 4294967295)"

    whole = " || ".join(frame(c) for c in FIELDS)
    lowered = " || ".join([*[frame(c) for c in FIELDS[:-1]], frame("text", f"translate(text, '{UPPER}', '{LOWER}')")])
    changed = f"doc_id IS NOT NULL AND ({crc32('CAST(doc_id AS VARCHAR)')}) % 5 = 0"
    parts = [
        f"leaves AS (SELECT doc_id, source, sha256({whole}) AS leaf, CASE WHEN {changed} THEN sha256({lowered}) ELSE sha256({whole}) END AS now FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, "
        "leaf AS h, now AS f, '' AS proof FROM leaves)",
    ]

    def climb(name: str, tree: str, keep: str) -> None:
        for k in range(levels):
            # whatever holds several nodes goes up a level; siblings are those of the run, each once
            parts.append(
                f"{name}n{k} AS (SELECT {tree} AS tree, p, min(h) AS h, p // {FANOUT} AS run, count(*) OVER (PARTITION BY {tree}) > 1 AS goes "
                f"FROM {name}{k} GROUP BY {tree}, p)"
            )
            parts.append(
                f"{name}r{k} AS (SELECT tree, run, string_agg(h, '' ORDER BY p) AS all_h, bool_or(goes) AS goes FROM {name}n{k} GROUP BY 1, 2)"
            )
            at = f"64 * (p % {FANOUT})"
            step = f"{name}{k}.{{0}}"
            parts.append(
                f"{name}{k + 1} AS (SELECT {keep}, CASE WHEN r.goes THEN p // {FANOUT} ELSE p END AS p, "
                f"CASE WHEN r.goes THEN sha256(all_h) ELSE {step.format('h')} END AS h, "
                f"CASE WHEN r.goes THEN sha256(substr(all_h, 1, {at}) || f || substr(all_h, {at} + 65)) ELSE f END AS f, "
                f"CASE WHEN r.goes THEN proof || substr(all_h, 1, {at}) || substr(all_h, {at} + 65) ELSE proof END AS proof "
                f"FROM {name}{k} JOIN {name}r{k} r ON r.tree IS NOT DISTINCT FROM {tree} AND r.run = p // {FANOUT})"
            )

    climb("a", "source", "doc_id, source, leaf")
    parts.append(
        f"b0 AS (SELECT doc_id, source, leaf, h AS subroot, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS p, h, f, proof FROM a{levels})"
    )
    climb("b", "1", "doc_id, leaf, subroot")
    return (
        "WITH " + ", ".join(parts) + " SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified "
        f"FROM b{levels}"
    )


ORACLE = _oracle()
