from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
#: Columns whose names clash with those that operators make.
CLASH = "row string, spans string, digest string, words string, h string, score string, kept string, block string"


def edge_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and long texts, ties and repeats, many kinds of white space, long runs."""
    rnd = random.Random(11)
    words = ["alpha", "Beta", "don't", "ç1", "x²", "中文", "we'll", "#", "***", "a", "9", "[b]", "é"]
    gaps = [" ", "  ", "\n", "\t", " ", " \n "]
    make = lambda n: "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(n))
    base = [make(n) for n in (3, 40, 120, 400)]
    rows = [(1, None), (2, ""), (3, ""), (4, " \n\t"), (5, base[1]), (6, base[1]), (7, base[2]), (8, base[2].replace("alpha", "gamma", 1)), (9, "z" * 3000), (10, "ab" * 500), (11, make(6000)), (12, base[3] + base[3]), (13, "q" + base[3][5:]), (14, base[0])]
    return [*rows, *((20 + i, make(rnd.choice([1, 10, 60])) + rnd.choice(base)[rnd.randrange(50) :]) for i in range(30))]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="session")
def clashing(spark):
    more = [x.strip().split()[0] for x in CLASH.split(",")]
    rows = [(i, t, "en", None, None, *("?" for _ in more)) for i, t in [*edge_rows(), (None, "without an id " * 30)]]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
