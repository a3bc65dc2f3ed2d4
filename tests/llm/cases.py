"""Documents with what operators have to stand: nulls, empty and long texts, ties, repeated rows, copies."""

import random

WORDS = "and the of ing er tion an re ha st le de que ment ciön straße été in on 日本 x 12 3.5".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def documents(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, 150 if i == 5 else rng.randint(1, 120)) for i in range(25)]
    rows = [(i * 7, t) for i, t in enumerate(base)]
    rows += [(1000 + i, base[i % 5].upper() if i % 2 else base[i % 5]) for i in range(12)]  # copies
    for i in range(10):  # near copies and shared passages
        words = base[5].split()
        words[rng.randrange(len(words))] = "edited"
        rows.append((2000 + i, " ".join(words)))
        rows.append((3000 + i, prose(rng, 20) + " " + base[6][:150] + " " + prose(rng, 20)))
    rows += [(4000, None), (4001, ""), (4002, "   \t\n"), (4003, "a"), (4004, "ab" * 400), (4005, "é" * 3000), (4006, "\x00\x01 nul"), (4007, prose(rng, 3000))]
    rows += [(None, base[7]), (None, "text of a row without an id"), (5000, base[8]), (5000, base[8]), (5000, "other text of the same id")]
    return rows


EMPTY = []
