"""Rows that break careless operators: NULLs anywhere, empty and very long texts, ties, repeated rows, clashing names."""

import random

import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long, size long, n long, node long, hash long, key string, language string, score double, bytes long"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def messy_rows():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdehilnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(60):
        rows.append((i, words(rng, rng.randrange(1, 160), vocabulary), "en", f"s{i % 4}"))
    for i in range(60, 75):  # copies, near copies
        text = rows[i - 60][1]
        rows.append((i, text if i % 3 else text + " extra", "en", "s0"))
    rows += [
        (75, None, None, None),
        (76, "", "xx", ""),
        (77, " \t\n\x0b\f\r ", "EN-us", "s1"),
        (78, "short", "en", None),
        (78, "short", "en", None),  # the same row again
        (78, "Short", "de", "s2"),  # the same id, another text
        (None, rows[3][1], "en", "s3"),
        (None, "nobody knows this one", None, "s3"),
        (79, words(rng, 9000, vocabulary), "en", "s1"),
        (80, "x" * 60_000, "en", "s1"),
        (81, "9" * 40_000 + " 1.2.3.4 ", "en", "s1"),
        (82, "é😀ß ÀÉ ñandú\x00nul \x1c\x1f fs", "es", "s2"),
        (-5, "negative id", "en", "s2"),
    ]
    rows += [(100 + i, "the same text in every one of these rows", "en", "hot") for i in range(40)]  # a hot group
    return [(a, t, l, s, *([None] if a == 75 else [7]), 1, 2, 3, 4, "k", "l", 0.5, 6) for a, t, l, s in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), NAMES).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], NAMES)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def none_first(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, str(v)) for v in r))
