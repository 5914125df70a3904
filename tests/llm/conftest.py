"""Small tables with everything that goes wrong."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LINE = "This line stands in many documents and is long enough to count."


def make_rows():
    rng = random.Random(7)
    words = [
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyzàéñ") for _ in range(rng.randint(2, 9))) for _ in range(400)
    ]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["  ", "\t", ""]) + LINE.upper() + " ")
        rows.append((i, "\n".join(lines), ("en", "de", None)[i % 3], ("a", "b", "c", None)[i % 4], 1))
    rows += [(100 + i, rows[i][1], "en", "a", 1) for i in range(5)]  # exact copies
    rows += [(110 + i, rows[20 + i][1] + " tail", "en", "a", 1) for i in range(5)]  # near copies
    rows += [(120, None, None, None, None), (121, "", "en", "", 0), (122, "...", "en", "a", 3), (123, "one", "en", "b", 3)]
    rows += [(124, "a  b  \n\n c\t", "en", "b", 9), (None, "no id " * 9, "de", "c", 1), (None, None, None, None, None)]
    rows += [(125, " ".join(rng.choice(words) for _ in range(30_000)), "en", "b", 1)]  # very long
    rows += [(126, "x" * 5_000, "en", "b", 1)]
    rows += [rows[3], rows[3]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows_of_documents():
    return make_rows()


@pytest.fixture(scope="session")
def documents(spark, rows_of_documents):
    return spark.createDataFrame(rows_of_documents, SCHEMA)


CLASHES = (
    "key bucket hash position shard slot keep segments n_tokens score component class size draws round language "
    "of_bucket first_place index place row mix_key mix_source blocks bounds through rounds text_hash line_keep scan "
    "join_id join_hash lang_pred rejected n_lines n_dropped ID N Token token_ids"
).split()


@pytest.fixture(scope="session")
def clashing(documents):
    """The documents with further columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    return documents.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
