import math

import zstandard
from pyspark.sql import functions as F

from tidemark.llm import language
from tidemark.llm.language import UNKNOWN, Compressors, document_model, fit_model, op2_language, spread_pieces, with_language

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "n_chars")
    got = op2_language(spark, FOLDER).join(truth, "doc_id").where("held_out and n_chars >= 100").toPandas()
    assert len(got) > 250
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()
    assert got["rejected"].mean() < 0.02


def test_null_empty_and_letterless_texts(documents):
    got = {r["doc_id"]: r for r in with_language(documents, fit_model(documents)).collect()}
    for doc in (120, 121, 122):
        assert (got[doc]["lang_pred"], got[doc]["score"], got[doc]["rejected"]) == (UNKNOWN, 0.0, True)
    assert got[123]["lang_pred"] in ("en", "de")


def test_dictionaries_are_bounded_and_whole_texts_count(spark, documents):
    model = fit_model(documents, samples=4, sample_chars=50)
    assert set(model.dictionaries) == {"en", "de"}
    assert all(len(d) <= 4 * (50 * 2 + 1) for d in model.dictionaries.values())
    assert abs(sum(model.shares.values()) - 1) < 1e-9
    compressors = Compressors(model)
    short, long = compressors.sizes("abc def"), compressors.sizes("abc def" + " ghij klm" * 1000)
    assert all(a < b for a, b in zip(short, long))


def test_no_labels_clashing_columns_and_empty_table(documents, clashing, empty):
    nothing = fit_model(documents.where("lang is null"))
    assert with_language(documents, nothing).where("lang_pred <> 'und' or not rejected").count() == 0
    model = fit_model(documents)
    got = with_language(clashing, model)
    assert set(got.columns) == set(clashing.columns) | {"score"}
    assert got.count() == documents.count()
    assert with_language(empty, model).count() == 0


def test_the_smallest_plain_compression_wins(spark):
    """Every text of the query by plain zstandard, one compressor for each call."""
    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    model = document_model(documents)
    kept = {
        name: zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        for name, content in model.dictionaries.items()
    }

    def size(text, name):
        parts = [text.lower()[i : i + language.WINDOW] for i in range(0, len(text), language.WINDOW)]
        compressors = [zstandard.ZstdCompressor(level=language.LEVEL, dict_data=kept[name], write_content_size=False) for _ in parts]
        return sum(len(c.compress(p.encode())) for c, p in zip(compressors, parts))

    got = op2_language(spark, folder).collect()
    assert len(got) == len(texts) >= 200
    for r in got:
        sizes = {name: size(texts[r["doc_id"]], name) for name in kept}
        assert r["lang_pred"] == min(sizes, key=lambda n: (sizes[n], -model.shares[n], n))
        least = min(sizes.values())
        weights = {n: model.shares[n] * math.exp((least - s) / language.BYTES_PER_NAT) for n, s in sizes.items()}
        assert abs(r["score"] - weights[r["lang_pred"]] / sum(weights.values())) < 1e-12


def test_equal_sizes_take_the_commoner_language():
    same = {"b": b"words of one kind", "a": b"words of one kind", "c": b"words of one kind"}
    compressors = Compressors(language.Model(same, {"a": 0.2, "b": 0.4, "c": 0.4}))
    found, score, rejected = compressors.classify("other words")
    assert (found, rejected) == ("b", True) and abs(score - 0.4) < 1e-12


def test_pieces_come_from_all_over_a_text(spark):
    rows = spark.range(300).select(F.concat(F.lit("header " * 40), F.repeat(F.col("id").cast("string"), 600)).alias("text"))
    got = [r[0] for r in rows.select(spread_pieces(F.col("text"), 90)).collect()]
    assert all(len(piece) <= 90 for piece in got)
    assert sum("header" in piece for piece in got) < len(got) / 2
    short = spark.createDataFrame([("as it is",), ("",)], "text string")
    assert [r[0] for r in short.select(spread_pieces(F.col("text"), 90)).collect()] == ["as it is", ""]
