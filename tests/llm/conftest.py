import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int, start: int = 0) -> str:
    r = random.Random(seed)
    parts = ["an", "the", "on", "er", "st", "ing", "ha", "le", "ou", "tion", "é", "ß"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that operators must survive: nulls, empty and long texts, repeats, names that clash with added columns."""
    long = prose(1, 40_000)
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, prose(2, 60)), (6, prose(2, 60)), (7, prose(2, 60)), (None, prose(3, 30)), (8, prose(4, 300) + "\n" + prose(4, 300))]
    rows += [(10 + i, prose(100 + i, 20 + i)) for i in range(60)]
    names = ["kept", "score", "n_tokens", "size", "key", "row", "taken", "target", "spans", "leaks", "sketch", "rank", "base_failed", "held_out", "class_id"]
    return spark.createDataFrame([(i, t, "s%d" % (k % 4) if k % 5 else None, *range(len(names))) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(10 + i, i % 2, int(i % 7 == 0)) for i in range(60)] + [(999, 1, 0), (None, 1, 1), (12, None, None)], "doc_id long, quality int, toxic int")


def words(text) -> list[str]:
    return WORD.findall(text or "")
