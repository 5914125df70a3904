import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm.merkle import FIELDS, ORACLE, Appended, folded, leaf_digest, manifest, op11_merkle

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """The root of a list of digests, and the siblings of each on every level."""
    paths = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        ups, belows = [], []
        for s in range(0, len(nodes), 16):
            run = nodes[s : s + 16]
            for i in range(len(run)):
                for leaf in below[s + i]:
                    paths[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
            ups.append(h(*run))
            belows.append(sum(below[s : s + 16], []))
        nodes, below = ups, belows
    return nodes[0], paths


def by_hand(rows):
    """Sorted result rows of the query for rows of ``FIELDS``."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    tops = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        part = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        tops.append((part, *climb([leaf_of(r) for r in part])))
    root, upper = climb([t[1] for t in tops])
    out = []
    for (part, subroot, paths), over in zip(tops, upper):
        for row, path in zip(part, paths):
            steps = path + over
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            now = leaf_of((*row[:4], row[4].translate(LOWERED))) if changed else leaf_of(row)
            for left, right in steps:
                now = h(left, now, right)
            proof = h(*[left + right for left, right in steps])
            out.append((row[0], leaf_of(row), subroot, root, proof, now, now == root))
    return sorted(out, key=str)


def collected(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300])
def test_appending_as_by_levels(n):
    nodes = [h(str(i)) for i in range(n)]
    appended = Appended(True)
    for node in nodes:
        appended.append(node)
    root, paths = climb(nodes)
    assert appended.finish() == root
    assert appended.witness == paths


def test_lone_node_of_a_larger_tree_is_taken_up():
    appended = Appended(False)
    appended.append("x")
    assert appended.finish(2) == h(h("x"))


@pytest.mark.parametrize("block", [16, 256])
def test_blocks_of_blocks(spark, block):
    rows = [(i, f"s{i % 40}" if i < 400 else "hot") for i in range(1_500)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string").withColumn("leaf", leaf_digest([F.col("doc_id")]))
    got = manifest(df.repartition(5), "source", ["doc_id"], "leaf", block).withColumn("again", folded(F.col("leaf"), F.col("witness")))
    found = {r["doc_id"]: r for r in got.collect()}
    assert len(found) == len(rows)
    sources = sorted({s for _, s in rows})
    parts = {s: [i for i, t in rows if t == s] for s in sources}
    tops = {s: climb([leaf_of([i]) for i in parts[s]]) for s in sources}
    root, upper = climb([tops[s][0] for s in sources])
    for s, over in zip(sources, upper):
        for i, path in zip(parts[s], tops[s][1]):
            r = found[i]
            assert (r["subroot"], r["root"], r["again"]) == (tops[s][0], root, root)
            assert [tuple(step) for step in r["witness"]] == path + over


def test_odd_rows(spark, documents, rows_of_documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    ordered = [(r[0], r[3], r[2], r[4], r[1]) for r in rows_of_documents]
    assert collected(op11_merkle(spark, str(tmp_path))) == by_hand(ordered)


def test_clashing_columns_and_empty_table(spark, clashing, empty, tmp_path):
    odd = clashing.drop("ID", "N").select("*", *[F.lit("x").alias(c) for c in ("tree", "block", "more", "digest", "o", "o0", "witness")])
    leaves = odd.withColumn("leaf", leaf_digest([F.col(c) for c in FIELDS]))
    got = manifest(leaves, "source", ["doc_id"], "leaf")
    assert set(got.columns) == {*leaves.columns, "subroot", "root"}
    assert got.count() == leaves.count() and got.select("root").distinct().count() == 1
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_merkle(spark, str(tmp_path)).count() == 0


def test_query_against_sql_and_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    got = collected(op11_merkle(spark, folder))
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*FIELDS).collect()]
    assert got == by_hand(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(con.execute(ORACLE).fetchall(), key=str) == got
    assert not all(r[-1] for r in got) and sum(r[-1] for r in got) > len(got) / 2
