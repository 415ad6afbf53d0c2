import random

import pytest

WORDS = "the of and to in is that for it as with was his he be on by at have are this not but had from".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rank long, length string, size long, bucket string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(n))


ODD = {
    1: None, 2: "", 3: " \t\n ", 4: "word", 5: "two words", 6: "Word", 7: "a b c d", 8: "a b c d e", 9: "A  b\tC d e",
    10: prose(1, 300), 11: prose(1, 300), 12: prose(1, 300) + " more", 13: prose(2, 60), 14: prose(2, 60).upper(),
    15: prose(3, 20_000), 16: "x" * 100_000, 17: "é" * 300 + " ñandú İstanbul ΑΣ", 18: "<|endoftext|> it's 12", 19: "\x1c\x0b\x85\xa0",
    20: prose(3, 20_000) + " end", 21: prose(4, 100), 22: prose(4, 80), 23: " ".join(prose(4, 100).split()[8:]),
}


def rows_of(texts: dict) -> list[tuple]:
    langs, sources = ["en", "de", None], ["s1", "s2", None, "s3"]
    return [(k, t, langs[k % 3], sources[k % 4], len(t or ""), 5, "x", 7, "b") for k, t in texts.items()]


@pytest.fixture(scope="session")
def odd_texts():
    return dict(ODD)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, copies, a row given twice, a row without an id, and columns with clashing names."""
    rows = rows_of(ODD)
    rows += [rows[9], (None, "no id here", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
