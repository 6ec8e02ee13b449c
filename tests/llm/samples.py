"""Small tables with what real ones may hold."""

from __future__ import annotations

import random
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, id string, key long, start int, words int, node long"


def sentence(seed: int, words: int, letters: str = "abcdeéñß") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(words))


def edge_rows() -> list[tuple]:
    """(doc_id, text): null and empty texts, copies, near copies, a long text, repeated rows."""
    base = sentence(1, 120)
    near = base.split(" ")
    near[5] = "changed"
    long = sentence(2, 9_000)
    texts = [
        None, "", " \n\t ", "One", "one", "a b c d", "A b  c d", base, base, " ".join(near), base.upper(),
        long, long[:20_000] + " " + base, "x" * 5_000, "xy" * 150, "\0" * 250, base + "\n" + base,
        "token = '0123456789abcdef0123456789abcdef01234567' and " + base,
        "\U0001F600 password: hunter2hunter2 " + sentence(3, 60), sentence(4, 60, "ABCDÉ"),
        "<|endoftext|>" + sentence(5, 20) + "<|endoftext|>", "'re it's  two   blanks \n end ",
    ]
    rows = [(number, text) for number, text in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, base), (None, None)]


def table(spark, rows: list[tuple], partitions: int = 3):
    """A table with extra columns whose names operators might use themselves."""
    full = [(*row, None, "x", 1, 2, 3, 4) for row in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)
