import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))  # helpers beside the tests
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, name string, row string, words string"


def prose(rng, n, stock="the of and to in that it was for on with as his they be at one have this from".split()):
    return " ".join(rng.choice(stock) + rng.choice(["", "", "ing", "ed", str(rng.randint(0, 9))]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with every awkward case: null, empty, white space, long, repeated, equal, near, null ids, few words."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    shared = prose(rng, 70)
    out = [(i, t, "en") for i, t in enumerate(base)]
    out += [(100 + i, base[i].replace(" ", "  \n"), "en") for i in range(5)]  # equal but for white space
    out += [(200 + i, base[i] + " tail", "en") for i in range(12)]  # near copies
    out += [(300 + i, prose(rng, 30) + " " + shared + " " + prose(rng, 20), "en") for i in range(4)]  # a shared passage
    out += [(400, None, "en"), (401, "", "en"), (402, " \t\n", "en"), (403, "one two", None), (404, "one  two", "fr")]
    out += [(405, "x" * 700, "fr"), (406, "ab" * 400 + "é" * 300, "fr"), (407, "Zu spät, größer! ñandú 漢字 \U0001f600 " * 30, "de")]
    out += [(408, prose(rng, 6000), "en"), (None, base[0], "en"), (None, "null id text with some words in it", None)]
    out += [(500, base[1], "en"), (500, base[1], "en"), (501, "### $$$ %%% | | | &&&", "en"), (502, "1234 5678", "en")]
    out += [(600 + i, "le la les des une et que pour dans avec " * 4 + str(i), "fr") for i in range(8)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, lang, "s", None if t is None else len(t), "k", "n", "r", "w") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
