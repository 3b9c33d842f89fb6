"""Row makers shared by the tests of this folder."""

import random


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}x{r.randrange(words)}" for _ in range(n))
