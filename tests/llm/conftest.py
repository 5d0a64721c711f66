import random

import pytest

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source) with near and exact copies, shared passages, repeated lines, odd spaces and edge cases."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["É", "naïve", "日本", "%%%", "#tag", "Mixed", "UPPER"]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    shared = prose(70)
    texts = [prose(rng.randint(1, 160)) for _ in range(40)]
    for _ in range(12):
        texts.append(prose(rng.randint(0, 60)) + shared[rng.randint(0, 8) :] + prose(rng.randint(0, 60)))
    for _ in range(14):
        near = list(rng.choice(texts[:40]))
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(near)
    out = []
    for i, t in enumerate(texts):
        sep = lambda: rng.choice([" ", " ", " ", "\n", "\t ", "  ", "\r\n"])
        out.append((i * 37 % 66 + 1000 * (i // 66), "".join(w + sep() for w in t), f"s{i % 5}"))
    out += [(900, None, "s1"), (901, "", None), (902, " \n\t ", "s1"), (903, "one", None), (904, "a b c d", "s2"), (905, "a b c d", "s2"), (906, "x " * 3000, "s3")]
    return out
