import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make_documents(seed: int = 3):
    """A small corpus with copies, near copies, shared passages, long, short, empty and null texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = prose(120)
    texts = [prose(r.randint(30, 200)) for _ in range(40)]
    texts += [texts[0]] * 5 + [texts[1]] * 2
    for base in texts[2:6]:
        for _ in range(6):
            words = base.split()
            for _ in range(r.randint(1, 6)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [prose(20) + " " + passage + " " + prose(30) for _ in range(12)]
    texts += [prose(3000), "x" * 1500, "ab " * 700, "", None, "one", "one", "two words", " \n\t ", "Eins ZWEI drei Vier"]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), len(t or "")))
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(make_documents(), COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null ids, repeated ids and rows, nulls everywhere, and a column whose name the operators use."""
    rows = [(None, "a b c d e f g h i j k l m n o p", None, None, None, 1), (7, "one two three", "en", "s", 13, 2),
            (7, "one two three", "en", "s", 13, 2), (7, "another text", None, "s", 12, 3), (None, None, None, None, None, None),
            (8, "a b c d e f g h i j k l m n o p", "en", None, 31, 4), (9, "", "de", "s", 0, 5)]
    return spark.createDataFrame(rows, COLUMNS + ", size long")
