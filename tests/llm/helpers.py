"""Small tables with every awkward case, shared by the tests."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n_words string, text_hash string, found string, words string, `class` string"
EXTRA = ("k", "w", "h", "f", "x", "c")


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """(doc_id, text): nulls, empties, long texts, ties, exact and near copies, shared passages, repeated rows."""
    base = words(1, 120, 5000)
    near = base[:60] + ["changed"] + base[61:]
    far = base[:40] + words(2, 80, 5000)
    passage = words(3, 30, 5000)
    long = words(4, 6000, 5000) + passage
    rows = [
        (0, " ".join(base)),
        (1, " ".join(near)),
        (2, " ".join(base)),
        (3, " ".join(far)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one two"),
        (8, "one  two"),
        (9, "ONE two"),
        (10, "  ".join(words(5, 40, 5000) + passage + words(6, 40, 5000))),
        (11, "\n".join(passage + words(7, 10, 5000))),
        (12, " ".join(long)),
        (13, "é ü ß x \U0001f600 " + " ".join(words(8, 30, 9))),
        (14, " ".join(["same"] * 60)),
        (None, " ".join(base)),
        (None, None),
        (15, " ".join(near[:-1])),
        (15, " ".join(near[:-1])),
        (15, "another text with the same id as the row before it has here"),
    ]
    return rows


def documents(spark, rows=None):
    rows = corpus() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *EXTRA) for i, t in rows], SCHEMA)
