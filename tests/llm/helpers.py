"""Texts for the tests."""


def sentence(rng, n, words=("alpha", "beta", "gamma", "delta", "kappa", "omega", "sigma", "theta", "zeta", "rho")):
    return " ".join(f"{words[rng.randrange(len(words))]}{rng.randrange(200)}" for _ in range(n))
