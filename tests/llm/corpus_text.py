import random

WORDS = [a + b for a in ("the", "on", "er", "in", "th", "ed", "re") for b in ("", "ha", "tion", "ing", "ou", "and")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def changed(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join("zz%d" % r.randrange(9999) if r.random() < share else w for w in text.split(" "))
