import random

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, ids string, fp string, digest string, base string, key string, row int"


def rows():
    r = random.Random(11)
    words = [f"{a}{b}" for a in ("th", "wh", "de", "la", "ein", "qu") for b in ("e", "at", "os", "ung", "ar", "is", "en")]
    made = [None, "", " \t\n", "one", "one  two", "one two", "one\ttwo", LONG, LONG, LONG + " end", "é 日本 😀 x", "a" * 5000]
    made += [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(60)]
    made += [made[20]] * 25 + [made[21].upper(), made[22] + " more", made[22] + "\nmore"]
    out = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None, "s3")[min(i % 7, 3)], None if t is None else len(t)) for i, t in enumerate(made)]
    out += [out[30], out[30], (None, "one two", None, None, 7), (None, None, "en", "s1", None)]
    return [(*x, True, 5, "x", "y", "z", "b", "k", 3) for x in out]


@pytest.fixture(scope="session")
def raw():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, raw):
    return spark.createDataFrame(raw, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
