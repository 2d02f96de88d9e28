"""Made-up prose for tests."""


def prose(rng, n, words=("on", "the", "alpha", "beta", "gamma", "delta", "ért", "né", "zwölf", "x1")):
    return " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(n))
