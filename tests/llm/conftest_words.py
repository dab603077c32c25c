"""Random prose for tests."""

WORDS = "the and of to in is was for on with by be at an or it as he she they".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "y"]) for _ in range(n))
