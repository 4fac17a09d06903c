import random

import pytest

from linkweave.session import ship_code

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(seed: int = 1):
    """Small documents with all awkward cases: nulls, blanks, copies, ties, a long text."""
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "ktmnr" for b in "aeiou" for c in ("n", "st", "l", "")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(40):
        text = make(rng.randint(1, 90))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 0))
    base = make(120)
    for i in range(40, 60):  # near copies of one text
        w = base.split()
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w), "en", "a", 0))
    rows += [(60, base, "en", "a", 0), (61, base, "de", "b", 0), (61, base, "de", "b", 0)]
    rows += [(62, None, "en", None, None), (63, "", None, "a", 0), (64, " \n\t ", "de", "c", 0)]
    rows += [(65, "One", "en", "c", 0), (66, "One two", "en", "c", 0), (67, "12 34 !!", "en", "c", 0)]
    rows += [(None, base, "en", "a", 0), (None, None, None, None, None)]
    rows += [(68, "Éa Éé\U0001f600 " * 50, "fr", "c", 0), (69, make(3000), "en", "a", 0)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """The documents with further columns whose names the operators use inside."""
    ship_code(spark)
    extra = "_row int, _items int, row string, hash long, _size string, words string, score int, key int"
    rows = [(*r, 1, 2, "x", 3, "y", "z", 4, 5) for r in rows_of()]
    return spark.createDataFrame(rows, f"{SCHEMA}, {extra}")


@pytest.fixture(scope="session")
def nothing(spark):
    ship_code(spark)
    return spark.createDataFrame([], SCHEMA)
