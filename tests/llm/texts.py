"""Small fixtures shared by the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp int, h string, _copies int"
WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=random.Random(-i).randint(2, 8))) for i in range(900)]


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choices(WORDS, k=n))


def edited(r: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(WORDS)
    return " ".join(words)


def rows(seed: int = 1, n: int = 120) -> list[tuple]:
    """Documents with families of near-copies, copies, a hot group, long, short, empty and null ones."""
    r = random.Random(seed)
    texts: list[str | None] = [sentence(r, r.randint(12, 160)) for _ in range(n)]
    for i in range(0, n, 6):
        texts += [edited(r, texts[i], r.randint(0, 9)) for _ in range(3)]
    texts += [texts[1]] * 40
    texts += [edited(r, texts[2], r.randint(1, 8)) for _ in range(20)]
    texts += [None, None, "", "", "   ", "one", "one", "One two three", "!!! ??? ...", sentence(r, 4000), sentence(r, 4000) + "\n" + sentence(r, 30)]
    return [(i, t, ("en", "de", None)[i % 3], ("a", "b", "c", None)[i % 4] if i % 3 else "a", len(t or ""), "clash", i, "clash", i) for i, t in enumerate(texts)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
