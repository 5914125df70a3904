import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm.simhash import RADIUS, fingerprints, op6_simhash, table_masks, within_radius


def test_block_tables_find_all(spark):
    rng = random.Random(3)
    centers = [rng.getrandbits(64) for _ in range(30)]
    values = set(centers)
    for c in centers:
        for _ in range(12):
            v = c
            for _ in range(rng.randint(1, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed] * 2, "fingerprint bigint")
    got = within_radius(df, df).collect()
    want = {(a, b) for a in signed for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= RADIUS}
    assert {(r["query"], r["fingerprint"]) for r in got} == want and len(got) == len(want)
    assert len(table_masks()) == 20


def test_query_on_edges(spark, documents, rows_of_documents, clashing, empty, tmp_path):
    def key(row):
        return (row[0] is not None, row[0] or 0)

    for name, table in (("plain", documents), ("clash", clashing), ("none", empty)):
        table.select(*[c for c in table.columns if c not in ("ID", "N")]).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = op6_simhash(spark, f"{tmp_path}/plain").collect()
    assert len(got) == len(rows_of_documents)
    assert op6_simhash(spark, f"{tmp_path}/clash").count() == len(got)
    assert op6_simhash(spark, f"{tmp_path}/none").count() == 0
    by = {r["doc_id"]: r for r in got}
    rows = sorted({(r[0], r[1] or "") for r in rows_of_documents if r[0] is not None}, key=key)
    texts = [t for _, t in rows]
    for i, (doc, text) in enumerate(rows[:-1]):
        k = len(text) // 4
        edited = text[: len(text) - k] + texts[i + 1][:k]
        assert by[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by[doc]["n_chars"] == len(text)
        same = 1 - (int(by[doc]["fingerprint"], 16) ^ int(by[rows[i + 1][0]]["fingerprint"], 16)).bit_count() / 64
        assert by[doc]["near_next"] == same
    assert by[120]["fingerprint"] == by[121]["fingerprint"] == "0" * 16
    for i in range(5):
        assert by[100 + i]["fingerprint"] == by[i]["fingerprint"]
    assert by[3]["near_edited"] > 0.6
    prints = [int(r["fingerprint"], 16) for r in got]
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] % 20 == 0:
            assert r["n_within"] == sum((int(r["fingerprint"], 16) ^ p).bit_count() <= RADIUS for p in prints) - 1
        elif r["doc_id"] is not None:
            assert r["n_within"] is None


def test_votes_by_hand(spark):
    df = spark.createDataFrame([(1, "a b B c"), (2, ""), (3, None), (4, " \n")], "id int, text string")
    got = {r["id"]: r["fingerprint"] for r in fingerprints(df, ["id"]).collect()}
    hashes = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in "abc"}
    votes = [sum((8 if w == "b" else 4) * (1 if hashes[w] >> i & 1 else -1) for w in "abc") for i in range(64)]
    want = sum(1 << i for i, v in enumerate(votes) if v > 0)
    assert got[1] & (2**64 - 1) == want
    assert got[2] == got[3] == got[4] == 0
