"""Small documents for the operators' tests."""

import random

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Rows that every operator must take: nulls everywhere, empty and blank texts, repeated rows, a long text, odd white space.
ODD = [
    (100, None, None, None, None),
    (101, "", "en", "src0", 0),
    (102, " \t\n\x0b\x0c\r ", "en", None, 7),
    (103, "one", "en", "src1", 3),
    (103, "one", "en", "src1", 3),
    (104, "Ünïcode wörds joined here 日本語 🙂", "de", "src1", 10),
    (105, "x" * 50_000, None, "src0", 50_000),
    (None, "a row without an id has words too", "en", "src0", 33),
    (106, "tab\tnewline\nreturn\rform\x0cfeed " * 20, "en", "src2", 1),
]


def words(n: int, seed: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 6))) if r.random() < 0.3 else f"w{r.randrange(vocabulary)}" for _ in range(n))


def near(text: str, seed: int, edits: int) -> str:
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def corpus() -> list[tuple]:
    """Plain texts, exact and near copies, shared passages, a hot source."""
    rows = []
    for i in range(24):
        rows.append((i, words(60 + 7 * i, i), "en", "src0" if i % 3 else "src1", 1))
    rows += [(24 + i, rows[3][1], "en", "src2", 1) for i in range(4)]
    rows += [(28 + i, near(rows[20][1], i, 3), "en", "src0", 1) for i in range(5)]
    passage = words(70, 999)
    rows += [(33 + i, words(20, 500 + i) + " " + passage + " " + words(15, 600 + i), "en", "src0", 1) for i in range(4)]
    rows += [(40, rows[3][1].upper(), "en", "src0", 1), (41, "two words", "en", "src0", 1), (42, "two words", "en", "src0", 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def clashing(df):
    """Extra columns whose names operators might use inside."""
    from pyspark.sql import functions as F

    names = ["id", "block", "size", "class", "u", "tie", "x", "p", "n", "sig", "key", "band", "comp", "host", "suffix", "declared", "place", "line", "gram", "copies", "copy", "rank", "w", "k", "t", "payload", "shard", "target", "s", "rest"]
    return df.select("*", *(F.lit("clash").alias(n) for n in names))
