import os
import random

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session", autouse=True)
def workers_find_package(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, key string, `__row` string, label int"


@pytest.fixture(scope="session")
def docs(spark):
    """Whole texts with nulls, empties, repeats, null ids, a long text, and columns named like the operators' own."""
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma,", "délta", "eps", "zeta.", "Eta", "theta", "iota;", "kappa"]

    def text(n):
        return " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(n))

    rows = []
    base = text(120)
    for i in range(60):
        rows.append((i, text(rng.randint(1, 90))))
    for i in range(60, 80):
        rows.append((i, base))
    for i in range(80, 100):
        cut = base.split(" ")
        cut[rng.randrange(len(cut))] = "other"
        rows.append((i, " ".join(cut)))
    rows += [(100, None), (101, ""), (102, "   \n\t"), (None, "no id at all here"), (None, None), (103, text(30_000)),
             (104, "one"), (105, "one two"), (7, rows[7][1]), (7, rows[7][1]), (8, "same id, other text")]
    full = [(i, t, "en" if (i or 0) % 2 else None, [None, "a", "b", "c"][(i or 0) % 4], None, 1, 0.5, "k", "r", 3)
            for i, t in rows]
    return spark.createDataFrame(full, CLASH).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASH)


def rows(df, *columns):
    """Rows as a sorted list of tuples; None sorts first."""
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(got, key=lambda r: [(x is not None, x) for x in r])
