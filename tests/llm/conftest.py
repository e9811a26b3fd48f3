import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest


@pytest.fixture(scope="session")
def spark():
    from starlit.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app="starlit-llm-tests",
                      extra={"spark.sql.shuffle.partitions": "4"})
    yield s


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows and ids, copies, a very long text."""
    base = " ".join(f"w{k * 7919 % 613}" for k in range(60))
    near = base.split()
    near[30] = "changed"
    long = " ".join(f"x{k * k % 997}" for k in range(20_000))
    return [
        (1, base, "en", "a"), (2, base.replace(" ", "\n"), "en", "a"), (3, base + "  ", "de", "b"),
        (4, " ".join(near), "en", "c"), (5, None, "en", "a"), (6, "", None, None), (7, " \t\n", "fr", "b"),
        (8, "one two", "en", None), (9, "One  TWO", "en", None), (10, long, "en", "a"), (11, "É ñ ß 漢字 😀 I'm 12", "es", "c"),
        (12, "dup row", "en", "a"), (12, "dup row", "en", "a"), (13, "same id, other", "en", "b"), (13, "texts here", "en", "b"),
        (None, "null id text that is its own", None, "a"), (14, base.upper(), "en", "d"), (15, "a", "en", "d"),
    ]
