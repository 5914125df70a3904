import collections
import hashlib
import string

from pyspark.sql import functions as F

from tidemark.llm.line_dedup import dedup_lines, keep_bitmaps

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def by_hand(rows, least=5):
    """Kept text of each row; rows without id are one document that comes first."""
    found = collections.defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            if len(key) >= 40:
                found[key].add(doc)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in found.items() if len(v) >= least}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := x.strip(" \t\n\x0b\x0c\r").translate(LOWER)) not in last or last[k] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_same_as_by_hand(documents, rows_of_documents):
    got = dedup_lines(documents).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows_of_documents)
    assert sum(r["n_dropped"] for r in got) >= 14


def test_query_matches_hashes(spark, documents, rows_of_documents, tmp_path):
    from tidemark.llm.queries import QUERIES

    documents.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_line_dedup"](spark, str(tmp_path)).collect()
    want = [(a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in by_hand(rows_of_documents)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_many_lines_need_several_words(spark):
    repeated = [f"repeated line number {i} that is certainly long enough" for i in range(200)]
    rows = [(d, "\n".join(repeated[d * 10 : 150 + d]) + "\nown", "", "", 0) for d in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows)
    bitmap = keep_bitmaps(df).where("doc_id = 0").select(F.explode("keep")).count()
    assert bitmap == 3


def test_clashing_columns_and_empty_table(clashing, documents, empty):
    got = dedup_lines(clashing)
    assert set(got.columns) == set(clashing.columns)
    want = dedup_lines(documents).select("doc_id", "text")
    assert sorted(map(tuple, got.select("doc_id", "text").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert dedup_lines(empty).count() == 0
