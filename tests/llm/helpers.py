"""Small tables with nulls, ties, copies, long texts and clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, shard int"
WORDS = "the of and quick brown fox jumps over lazy dog été señor straße naïve alpha beta gamma delta".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "ing", "er", "s"]) + str(r.randrange(9)) * (r.random() < 0.2) for _ in range(n))


def texts() -> list:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    far[::9] = ["x"] * len(far[::9])
    return [None, "", " \n\t ", "one", "Two words", "123 456", base, base.upper(), base, " ".join(near), " ".join(far), prose(2, 3000), "aaaa" * 300, base + "\n" + prose(3, 50), prose(4, 40) + base, "ß" * 150, "ab " * 400, base]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    made = [(i, t, None if i % 5 == 3 else "en", "s", None if t is None else len(t), "k", 7) for i, t in enumerate(rows)]
    return spark.createDataFrame(made, DOCS)


def with_oddities(spark):
    """docs plus a repeated row and a row without id."""
    d = docs(spark)
    return d.unionByName(d.where("doc_id = 6")).unionByName(spark.createDataFrame([(None, "no id here at all", "en", None, None, None, None)], DOCS))
