import random

import pytest

#: An extra column whose name an operator uses inside, too.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor string, `start` int, sketch string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefgimnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows):
        """rows: (doc_id, text) or (doc_id, text, lang)."""
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, None, None, "x", 1, None) for r in rows], SCHEMA)

    return docs


@pytest.fixture(scope="session")
def corpus(words):
    """Texts with copies, near copies, shared passages, and the awkward cases."""
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = text(70), text(160).split(" ")
    rows = [(i, text(rng.randint(5, 200))) for i in range(30)]
    rows += [(100 + i, text(30) + "\n" + shared + "\t" + text(rng.randint(0, 60))) for i in range(12)]
    for i in range(25):
        w = list(base)
        for _ in range(rng.randint(0, 22)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, " ".join(base)) for i in range(6)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one"), (405, "Ünïcode \x0b漢字 🙂 " * 3), (406, "a " * 300), (407, "ab" * 900), (408, text(8000)), (None, shared), (10, rows[10][1])]
    rng.shuffle(rows)
    return rows
