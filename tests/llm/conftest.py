import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone light under seven paper winter glass north copper field signal water bright little amber window harbour metal quiet orange".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents():
    """Copies, near copies, shared lines and passages, and every odd case."""
    rng = random.Random(3)
    texts = [sentence(rng, rng.randrange(5, 120)) for _ in range(40)]
    line = "This line is the same in many documents, word for word."
    base = sentence(rng, 90).split()
    for k in range(12):
        edited = list(base)
        for _ in range(k % 4):
            edited[rng.randrange(len(edited))] = f"edit{k}"
        texts.append(" ".join(edited))
    texts += [f"{sentence(rng, 20)}\n  {line.upper() if k % 2 else line} \n{sentence(rng, 10)}" for k in range(7)]
    texts += [texts[3], texts[3].upper(), texts[5], None, "", " \n ", "a", "a b c", "Ünïcödé tëxt wïth äccents", sentence(rng, 6000), f"{line}\n{line}"]
    rows = [(k, t, "en", "s", None) for k, t in enumerate(texts)]
    return rows + [rows[7], (None, texts[4], None, None, None), (None, None, None, None, 3)]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names operators may use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "th": F.lit("x"), "n": F.lit(2.0), "key": F.lit(None).cast("int"), "size": F.lit(5), "__own": F.lit(1), "__id": F.lit(4)}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
