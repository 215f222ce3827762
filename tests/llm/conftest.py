import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """[(id, text)] with copies, near copies, shared passages, odd blanks, long and empty texts, and nulls."""
    rng = random.Random(7)
    stems = ["an", "er", "that", "in", "th", "ou", "the", "Ré", "ion", "ES", "x", "🙂", "of"]

    def word():
        return "".join(rng.choice(stems) for _ in range(rng.randint(1, 4)))

    def prose(n):
        return "".join(word() + rng.choice([" ", " ", " ", "  ", "\n", ", "]) for _ in range(n))

    passage, line = prose(60), "A line that many documents have in common, word for word, each and every time."
    texts = [prose(rng.randint(1, 300)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5] + " tail", texts[5].replace("the", "teh", 2), texts[8][40:], texts[3].upper()]
    texts += [prose(80) + passage + prose(30), passage, prose(20) + passage, passage + passage, prose(9) + passage[30:]]
    texts += [f"{prose(30)}\n{line}\n{prose(30)}\n{line}" for _ in range(12)]
    near = prose(120).split(" ")
    for k in range(8):
        copy = list(near)
        copy[10 * k + 3] = "changed"
        texts.append(" ".join(copy))
    texts += ["", None, " \n\t ", "one", "a b c", "a b c", "a  b\tc", "A B C", "a b c d e", "a b c d e f", "ab " * 400,
              "x" * 5000, "xy" * 300, "same " * 12, prose(6000), "    nbsp　 wide", "<|endoftext|> don't  it's\r\n\r\n 12 345"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 2}" if i % 7 else None, len(t or "")) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
