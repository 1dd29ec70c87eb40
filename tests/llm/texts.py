"""Invented prose for the tests."""

import random

WORDS = "the of and to in is that was for on are with as it his they be at one have this from or had by hot but some what there we can out other".split()


def prose(rng: random.Random, words: int, per_line: int = 12) -> str:
    out = []
    for k in range(words):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", str(rng.randint(0, 99))]))
        out.append("\n" if k % per_line == per_line - 1 else " ")
    return "".join(out).strip()
