"""Small documents with every odd case: nulls, empty and long texts, repeated rows, equal ids, clashing columns."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "class long, key string, size string, _doc string, spans string, chunk string, kept string, n_words string"
)
CLASHES = (7, "k", "s", "d", "sp", "c", "kept", "w")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = ["ta", "ri", "mon", "sel", "va", "do", "ker", "lin", "os", "ul", "pre", "gan"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("\n" if i % 37 == 36 else "") for i, w in enumerate(words))


def documents() -> list[tuple]:
    rng = random.Random(3)
    passage = prose(100, 90)
    rows: list[tuple] = []
    for i in range(40):
        text = prose(i, 30 + 9 * i)
        if i % 5 == 0:
            text = f"{text}\n{passage} {prose(500 + i, 12)}"
        rows.append((i, text, ["en", "de", None][i % 3], [f"s{i % 4}", None][i % 7 == 6]))
    for i in range(40, 52):  # near copies of document 20, and copies of those
        words = rows[20][1].split(" ")
        if i % 3:
            words[rng.randrange(len(words))] = f"changed{i}"
        rows.append((i, " ".join(words), "en", "s0"))
    long_text = prose(900, 30_000)
    rows += [
        (60, long_text, "en", "s1"),
        (61, long_text[:200_000] + " end", "en", "s1"),
        (62, "ñandú Überfluß été 😀 " * 60, "es", "s2"),
        (63, "x" * 3000, "en", "s2"),
        (64, "ab" * 900 + "c" + "ab" * 900, "en", "s2"),
        (65, "one two three four", "en", "s3"),
        (66, "one two three four", "en", "s3"),
        (67, "   \n\t \x0b ", "en", "s3"),
        (68, "123 456 --- !!! ???", "en", "s3"),
        (69, "", "en", None),
        (70, None, "en", "s3"),
        (70, None, "en", "s3"),  # a repeated row
        (71, rows[3][1], "en", "s3"),
        (71, rows[3][1], "en", "s3"),
        (71, rows[4][1], None, "s3"),  # an id with another text
        (None, rows[5][1], "en", "s3"),
        (None, rows[5][1], "en", "s3"),
        (None, None, None, None),
        ((1 << 60) + 1, "a very large id should come out of it all as it went in", "en", "s3"),
        (72, "a\x00b <|endoftext|> c's don't  two   spaces\x1c x 　 y", "en", "s3"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None, *CLASHES) for r in rows]


@pytest.fixture(scope="session")
def rows_in():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows_in, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "documents.parquet")
    spark.createDataFrame(rows_in, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
