"""Invented prose and labelled rows for the tests."""

import random

SYLLABLES = "an be co du el fi go ha in ja ko lu".split()


def prose(seed: int, n: int) -> str:
    """`n` invented words in lines of twelve."""
    r = random.Random(seed)
    words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


def labelled(spark, n: int = 400):
    def text(i):
        body = prose(1000 + i, 60 + i % 40)
        if i % 4:
            return body
        return body.upper().replace(" ", "!! ") if i % 8 else " ".join(w + "$$$" for w in body.split())

    rows = [(i, text(i)) for i in range(n)]
    labels = [(i, int(i % 4 > 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")


def _vectors() -> list[tuple]:
    """Labelled vectors with nulls, non-finite components, ties and repeated rows."""
    r = random.Random(5)
    rows = [(i, [r.uniform(-0.4, 0.4) for _ in range(8)], r.choice([0, 1, 1, 2, 9]), "s") for i in range(1, 420)]
    same = [0.25] * 8
    rows += [(i, same, i % 2, "s") for i in (500, 501, 502, 503, 504, 505, 600, 700, 701, 702)]
    rows += [(800, None, 1, "s"), (801, same, None, "s"), (802, [0.1, None] * 4, 1, "s"), (803, [float("nan")] * 8, 1, "s"), (804, [float("inf")] * 8, 1, "s")]
    rows += [(900, [-x for x in same], 7, "s"), (901, [0.0] * 8, 7, "s")]
    return rows


def _turns() -> list[tuple]:
    """Conversations with nulls, odd roles, ties, repeated rows and gaps."""
    r = random.Random(6)
    rows = []
    for c in range(150):
        turn = 0
        for _ in range(r.randint(1, 7)):
            turn += r.choice([0, 1, 1, 1, 1, 3])
            text = r.choice(["Yes.", "No!", "Why?", "and so", " \t\n", "", "Long. " * 4, "é ü.", None])
            rows.append((c, r.choice([turn, turn, turn, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text, 3))
    rows += rows[:4] + [(None, 1, "user", "No id.", 3), (None, None, None, None, 3)]
    return rows


VECTORS, TURNS = _vectors(), _turns()
