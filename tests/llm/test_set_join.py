import random
import re
import string

import numpy as np
import pytest

from tidemark.llm import set_join
from tidemark.llm.components import components
from tidemark.llm.set_join import NO_ID, join_components, keep_one, op3_jaccard_join

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def by_hand(rows, k, percent):
    ids = [NO_ID if r[0] is None else r[0] for r in rows]
    sets = [shingles(r[1], k) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    real = {g: [i for i, h in zip(ids, group) if h == g and i != NO_ID] for g in group}
    return sorted(((i, len(s), min(real[g], default=None)) for i, s, g in zip(ids, sets, group)), key=str)


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (1, 50)])
def test_same_as_by_hand(documents, rows_of_documents, k, percent):
    got = join_components(documents, k, percent).select("id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows_of_documents, k, percent)


def test_chains_and_families_of_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for family in range(6):
        words = [f"f{family}{w}" if i % 2 else w for i, w in enumerate(base)]
        for step in range(25):
            if step % 2:
                words = list(words)
                words[(step * 7) % 60] = f"new{family}x{step}"
            rows.append((family * 100 + step, " ".join(words), "", "", 0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for k, percent in ((3, 90), (1, 80), (2, 70)):
        got = join_components(df, k, percent).select("id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == by_hand(rows, k, percent)


def test_one_of_each_group_stays(documents, rows_of_documents, clashing, empty):
    want = {i for i, _, c in by_hand(rows_of_documents, 5, 80) if c is None or i == c}
    got = [NO_ID if r["doc_id"] is None else r["doc_id"] for r in keep_one(documents).collect()]
    assert set(got) == want
    assert got.count(3) == 1
    assert set(keep_one(clashing).columns) == set(clashing.columns)
    assert keep_one(empty).count() == 0
    assert join_components(empty).count() == 0


def test_query_and_null_ids(spark, tmp_path):
    """A null id is never the least; a component without a real one has none, and keeps one row."""
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(None, text), (6, text), (5, text + " tail"), (None, other), (None, other + " tail"), (None, None), (9, ""), (None, "")]
    rows = [(i, t, "en", "a", 1) for i, t in rows]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_jaccard_join(spark, str(tmp_path)).collect()
    want = [(None if i == NO_ID else i, n, c) for i, n, c in by_hand(rows, 3, 90)]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(want, key=str)
    assert {r["component_id"] for r in got} == {5, 9, None}
    kept = keep_one(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted(str(r["doc_id"]) for r in kept if r["text"]) == ["5", "None"]


def test_query_as_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = op3_jaccard_join(spark, folder).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == by_hand(rows, 3, 90)
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == links_by_hand(rows, 3, 90)


def links_by_hand(rows, k, percent):
    sets = [shingles(r[1], k) for r in rows]
    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                n[i] += 1
                n[j] += 1
    return sorted((NO_ID if r[0] is None else r[0], x) for r, x in zip(rows, n))


def test_links_as_by_hand(spark, documents, rows_of_documents, monkeypatch):
    got = join_components(documents, 3, 90).select("id", "n_links").collect()
    assert sorted(map(tuple, got)) == links_by_hand(rows_of_documents, 3, 90)
    # a family of near copies, some of them twice, whose pairs mostly link, in one block and in several
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        words = [*base[: 100 + i % 12], f"own{i}"]
        rows += [(i, " ".join(words), "", "", 0)] * (2 if i % 9 == 0 else 1)
    df = spark.createDataFrame(rows, documents.schema)
    want = links_by_hand(rows, 3, 90)
    assert sum(n for _, n in want) > 20 * len(rows)
    for sets in (128, 16):
        monkeypatch.setattr(set_join, "BLOCK_SETS", sets)
        got = join_components(df, 3, 90).select("id", "n_links").collect()
        assert sorted(map(tuple, got)) == want


def test_long_bitmaps_count_what_only_one_set_has():
    """A bit for the parity of each residue; of two lengths, the longer one folds to the other."""
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, size=n, dtype=np.uint64) for n in (256, 257, 512, 513, 1000, 0)]
    sets[3][:500] = sets[2][:500]
    text = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    maps = set_join.parity_bitmaps(text, np.concatenate(sets), np.array([len(s) for s in sets])).to_pylist()
    assert [m and 8 * len(m) for m in maps] == [None, 512, 512, 1024, 1024, None]
    for i in range(1, 5):
        for j in range(1, 5):
            width = 8 * min(len(maps[i]), len(maps[j]))
            odd = [np.bincount((s % np.uint64(width)).astype(int), minlength=width) % 2 for s in (sets[i], sets[j])]
            assert set_join.differing_bits(maps[i], maps[j]) == (odd[0] != odd[1]).sum()
    assert set_join.differing_bits(maps[2], maps[3]) <= 12 + 13
    assert set_join.differing_bits(maps[3], maps[4]) > 300


def test_long_unlike_texts_are_not_moved(spark, documents, monkeypatch):
    """Long texts that share rare shingles but are unlike meet by their bitmaps only; links between long texts stay."""
    draw = random.Random(3)
    common = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join([*common, *(f"o{i}w{j}" for j in range(1600 + 20 * i))]), "", "", 0) for i in range(12)]
    # near copies on both sides of 512 shingles, where the length of the bitmap changes
    base = [f"b{i}" for i in range(540)]
    for i in range(12):
        words = base[: 500 + 3 * i]
        words[draw.randrange(len(words))] = f"new{i}"
        rows.append((100 + i, " ".join(words), "", "", 0))
    df = spark.createDataFrame(rows, documents.schema)
    # a table of counts that tells nothing, as in a corpus far larger than it
    monkeypatch.setattr(set_join, "_counted", lambda chunks: np.zeros(set_join.CELLS, dtype=np.int64))
    compared, linked = [], set_join._linked
    monkeypatch.setattr(set_join, "_linked", lambda pairs, *rest: compared.append(pairs.collect()) or linked(pairs, *rest))
    got = join_components(df, 3, 90).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == by_hand(rows, 3, 90)
    assert sorted((r["id"], r["n_links"]) for r in got) == links_by_hand(rows, 3, 90)
    assert {r["component_id"] for r in got if r["id"] >= 100} == {100}
    unlike = {r["class"] for r in got if r["id"] < 100}
    assert compared and not any({p["a"], p["b"]} & unlike for pairs in compared for p in pairs)


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
