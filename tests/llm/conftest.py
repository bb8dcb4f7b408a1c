import random

import pytest

CLASHING = "doc_id long, text string, kept string, n_words long, mark string, d string, source string, size string, places string, row string"


def odd_texts() -> list[tuple]:
    """(id, text): nulls, empty and long texts, repeated rows, repeated ids, ties, odd white space and characters."""
    rng = random.Random(5)
    words = ["the", "of", "Ünder", "日本", "a", "b.", "x|y", "😀", "And", "and"]
    long = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(60_000))
    base = " ".join(f"w{i}" for i in range(120))
    lines = "\n".join(["alpha beta gamma", "delta epsilon", "", "zeta eta", "theta"])
    return [
        (1, None),
        (2, ""),
        (3, "   \n\t \x0b\x0c\r "),
        (4, "one"),
        (5, "one two three"),
        (6, "One TWO three"),
        (7, base),
        (8, base),
        (8, base),
        (9, base.replace("w5 ", "other ")),
        (9, "the same id with another text " * 20),
        (None, "no id here but words " * 15),
        (None, None),
        (10, long),
        (11, long[: len(long) // 2]),
        (12, lines),
        (13, lines + "\n" + lines),
        (14, "x\n" * 50),
        (15, "a b c d \x85e \x00f ▁g  h"),
        (16, "rep rep rep " * 40),
        (17, ("Licensed under the Apache License, Version 2.0.\n" + base)),
        (18, "\n\n\n"),
        (19, base + " " + base),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "k", 7, "m", "d", s, "z", "p", "r") for n, (i, t) in enumerate(odd_texts()) for s in [None if n % 7 == 0 else f"s{n % 3}"]]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
