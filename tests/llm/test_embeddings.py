import math

import numpy as np

from tidemark.llm.embedding_dedup import fit_tables, near_duplicates, op4_embedding_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_hand(rows, threshold=0.9):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, dtype=np.float32).astype(float)
        return a / np.linalg.norm(a)

    units = [unit(v) for _, v, _ in rows]
    links = [[i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold for j, b in enumerate(units)] for i, a in enumerate(units)]
    group = list(range(len(rows)))
    for i, row in enumerate(links):
        for j, linked in enumerate(row):
            if linked:
                group = [group[i] if g == group[j] else g for g in group]
    least = {g: min(r[0] for r, h in zip(rows, group) if h == g) for g in group}
    return [(r[0], sum(l), least[g], r[0] == least[g]) for r, l, g in zip(rows, links, group)]


def test_clusters_and_edges(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        center = rng.normal(size=32)
        for i in range(10):
            rows.append((c * 10 + i, (center + 0.15 * rng.normal(size=32)).tolist(), 0))
    rows += [(500 + i, rows[i][1], 1) for i in range(20)]  # equal vectors
    rows += [(600, None, 0), (601, [], 0), (602, [0.0] * 32, 0), (603, [1.0, None] * 16, 0), (604, [float("nan")] * 32, 0)]
    rows += [(605, [float("inf")] + [1.0] * 31, 0), (606, [1.0, 2.0], 0), (607, [2.0, 4.0], 0), (608, [3.0] * 32, None)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = by_hand([(i, v, l) for i, v, l in rows])
    assert sorted(map(tuple, got)) == sorted(want)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    import tidemark.llm.embedding_dedup as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    center = rng.normal(size=16)
    rows = [(i, (center + rng.uniform(0.05, 0.3) * rng.normal(size=16)).tolist(), 0) for i in range(150)]
    got = {r["vec_id"]: r for r in module.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {w[0]: w for w in by_hand(rows)}
    assert all(got[i]["n_links"] <= want[i][1] for i in got)
    assert sum(r["n_links"] for r in got.values()) > 0.95 * sum(w[1] for w in want.values())


def test_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9 * a + math.sqrt(1 - 0.81) * b
    for rows in (5_000, 200_000):
        tables = fit_tables(a, rows)
        found = (tables.keys(a) == tables.keys(near)).any(axis=1).mean()
        assert found >= 0.93


def test_query_and_empty_table(spark):
    got = op4_embedding_dedup(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(by_hand(rows))
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
