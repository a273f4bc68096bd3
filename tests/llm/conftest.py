import random

import pytest

WHITE = " \t\n\r\x0b\x0c"


def words(text):
    """Words of the contract: lower-case A-Z, split at ASCII white space."""
    return (text or "").encode().lower().split()


def prose(seed, n):
    r = random.Random(seed)
    stems = ["an", "the", "er", "ti", "on", "re", "ble", "wh", "ou", "ea", "st", "nd"]
    out = []
    for k in range(n):
        out.append("".join(r.choice(stems) for _ in range(r.randint(1, 3))))
        if k % 9 == 8:
            out[-1] += "."
        if k % 31 == 30:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h string, cls string, label string, size string, k string, _id string, _t string, _dropped string, _cut string, row string, _row string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeated rows and ids, near copies and columns with clashing names."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (0, base, "en", "a"), (1, base, "en", "b"), (2, " ".join(near), "en", None), (3, None, None, None), (4, "", "en", "a"), (5, " \n\t ", "en", "a"),
        (6, "one", "en", "c"), (7, "one two", "fr", "c"), (8, "ONE  Two", "fr", "c"), (9, prose(2, 9000), "en", "b"), (10, "été Ünï — 漢字 𝄞 " * 30, "fr", "b"),
        (11, prose(3, 60), "en", "c"), (11, prose(3, 60), "en", "c"), (12, prose(4, 70), "en", "a"), (12, prose(5, 70), "en", "a"), (None, prose(6, 80), "en", "a"), (None, None, None, "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 7, "x", "y", "z", "w", "v", "i", "t", "d", "c", "r", "q") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def longest():
    return prose(7, 400_000)  # over two pieces of the word reader
