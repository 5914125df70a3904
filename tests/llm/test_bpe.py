import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from tidemark.llm.bpe import Merger, decoder, public_vocabulary, with_token_ids


@pytest.fixture(scope="module")
def vocabulary():
    return public_vocabulary()


@pytest.fixture(scope="module")
def other():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder(vocabulary):
    return vocabulary.coder()


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def by_hand(piece, ranks):
    """Merge the leftmost pair of least rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return packed([ranks[p] for p in parts])
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_pieces_merge_as_by_hand(vocabulary):
    rng = random.Random(1)
    merger = Merger(vocabulary.ranks)
    pieces = [bytes(rng.choice(b"aabetinorsth \xc3\xa9") for _ in range(rng.randint(1, 70))) for _ in range(400)]
    pieces += [b"a" * n for n in range(1, 70)] + [b"ab" * 40, "é".encode() * 33]
    want = [packed([merger.ranks[p]]) if p in merger.ranks else by_hand(p, merger.ranks) for p in pieces]
    assert merger.many(pieces) == want
    assert [merger.one(p) for p in pieces] == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80), st.lists(st.sampled_from(["don't", "  ", "\n", " \n", "x1", "Ünï", "$$$", "\r\n", "\x1c", " ", "日本", "a."])))
def test_texts_as_the_library(coder, other, text, parts):
    for t in (text, " ".join(parts), "".join(parts)):
        (got,) = coder.encode([t])
        assert got == packed(other.encode_ordinary(t))
        assert coder.decode(got) == t.encode()


def test_column_functions(spark, documents, rows_of_documents, vocabulary, other):
    coded = with_token_ids(documents, vocabulary)
    got = coded.select("text", "token_ids", decoder(spark, vocabulary)("token_ids").alias("back")).collect()
    assert len(got) == len(rows_of_documents)
    for row in got:
        assert bytes(row["token_ids"]) == packed(other.encode_ordinary(row["text"] or ""))
        assert bytes(row["back"]) == (row["text"] or "").encode()


def test_round_trip_in_one_worker(spark, documents, rows_of_documents, vocabulary, other, monkeypatch):
    from tidemark.llm import bpe

    code = bpe.round_trip(spark, vocabulary)
    got = documents.select("text", code("text").alias("coded"))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for row in got.select("text", "coded.ids", "coded.decoded").collect():
        assert bytes(row["ids"]) == packed(other.encode_ordinary(row["text"] or ""))
        assert bytes(row["decoded"]) == (row["text"] or "").encode()


def test_portions_are_bounded_and_whole(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import bpe

    monkeypatch.setattr(bpe, "TEXTS_AT_ONCE", 3)
    monkeypatch.setattr(bpe, "BYTES_AT_ONCE", 10)
    texts = ["a" * n for n in (1, 2, 3, 4, 30, 9, 1, 1)] + [None]
    portions = list(bpe._portions(pa.array(texts)))
    assert [t for p in portions for t in p] == [t or "" for t in texts]
    assert all(len(p) <= 3 and (len(p) == 1 or sum(map(len, p)) <= 10) for p in portions)


def test_nothing_stays_behind_and_unknown_ids_fail(vocabulary):
    assert vocabulary.coder() is not vocabulary.coder()
    with pytest.raises(KeyError):
        vocabulary.coder().decode(packed([1 << 30]))


def test_full_caches_keep_results_right(vocabulary, other, monkeypatch):
    from tidemark.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    coder, rng = vocabulary.coder(), random.Random(3)
    words = ["".join(rng.choice("abcdeé'") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for _ in range(40):
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 20))) + rng.choice(["", ".", "\n", "\0", " \n x"]) for _ in range(5)]
        assert coder.encode(texts) == [packed(other.encode_ordinary(t)) for t in texts]
        assert len(coder.chunks) <= 20 and all(len(c) <= bpe.CACHED_LENGTH for c in coder.chunks)


def test_long_piece(vocabulary, other):
    text = "ab" * 100_000
    assert vocabulary.coder().encode([text]) == [packed(other.encode_ordinary(text))]


def test_clashing_columns_and_empty_table(clashing, empty, vocabulary):
    got = with_token_ids(clashing, vocabulary)
    assert set(got.columns) == set(clashing.columns)
    assert got.where("octet_length(token_ids) > 0").count() > 50
    assert with_token_ids(empty, vocabulary).count() == 0


def test_query(spark, other):
    from tidemark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op9_byte_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = other.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
