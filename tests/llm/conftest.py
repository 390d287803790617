import random

import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, cell int, taken string, score string, digest string, shard string, block string, target string, kept string"
BASE = {
    "en": "the of and to in is was that with for on this are by an be at from or have",
    "de": "der die und das von zu mit den ein ist nicht auf für sich dem werden schön über größe",
    "fr": "le la les des et est une que dans pour qui sur par pas être avec très où déjà",
    "es": "el la los las que de en por con para una es del más como pero año según también",
}


def sentence(rng, lang, n):
    words = BASE[lang].split()
    return " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) + str(rng.randint(0, 40)) * (rng.random() < 0.3) for _ in range(n))


def corpus():
    """About 130 rows: copies, near copies, shared passages, gaps, ties, long and empty texts."""
    rng = random.Random(7)
    rows, shared = [], sentence(rng, "en", 60)
    for i in range(80):
        lang = rng.choice(list(BASE))
        text = "\n".join(sentence(rng, lang, rng.randint(3, 30)) for _ in range(rng.randint(1, 8)))
        if i % 9 == 0:
            text += " " + shared + " " + sentence(rng, lang, 20)
        rows.append((i, text, lang if i % 7 else None, f"s{i % 3}" if i % 11 else None))
    base = rows[3][1] + "\n" + sentence(rng, "en", 90)
    for i in range(80, 100):
        words = base.split(" ")
        words[(i * 7) % len(words)] = f"edit{i}"
        rows.append((i, " ".join(words), "en", "s0"))
    for i in range(100, 112):
        rows.append((i, rows[5][1], "en", "s1"))
    rows += [(112, None, None, None), (113, "", "en", "s0"), (114, "   \n\t ", None, "s2"), (115, "1234 5678 !!", None, "s1"), (116, "word", "en", ""), (117, "word", "en", "s0"), (118, "two words", "en", "s0")]
    rows += [(119, "la la la " * 40, "fr", "s0"), (120, "x" * 70_000, None, "s2"), (121, sentence(rng, "de", 9000), "de", "s2"), (122, "日本語 のテキスト ÀÉ <|endoftext|> don't İstanbul ΟΔΟΣ", None, "s1")]
    rows += [rows[10], rows[10], (None, "a row without an id but with words", None, "s0"), (None, None, "en", None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 2, 1, *["x"] * 7) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def plain(spark, rows):
    """Rows with distinct ids, as the plain versions take them."""
    seen = {r[0]: r for r in rows if r[0] is not None}
    return list(seen.values())


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
