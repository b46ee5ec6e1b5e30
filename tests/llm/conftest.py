import random

import pytest

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, label string, `key` string, v int"


def words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty, very long and repeated texts, ties, and columns that clash with internal names."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = list(base)
    near[60] = "changed"
    texts = [None, "", "   \n\t ", "one", " ".join(base), " ".join(base), " ".join(near), "Same line\n" * 30, "x" * 9000, " ".join(words(rng, 6000)), "ümläut ÉÉ   zwölf 😀 " * 40, "<|endoftext|> a<|endoftext|>b", "a b c d e f g h i j k l m n o p q r s t u v"]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 4 else None, None if t is None else len(t), i, "l", "k", 1) for i, t in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    rows.append((None, " ".join(base), None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(13)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def prose(spark):
    """Planted copies: exact, near, shared passages, and clean documents."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words(rng, 150, "abcdefghijklmnop"))))
    for i in range(8):
        rows.append((100 + i, rows[i][1]))
        w = rows[20 + i][1].split()
        w[rng.randrange(150)] = "edited"
        rows.append((200 + i, " ".join(w)))
    passage = words(rng, 70, "qrstuvwxyz")
    for i in range(6):
        noisy = [w if rng.random() > 0.04 or i < 3 else "zz" for w in passage]
        rows.append((300 + i, " ".join(words(rng, 80) + noisy + words(rng, 60))))
    return spark.createDataFrame(rows, "doc_id long, text string")
