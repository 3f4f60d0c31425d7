"""Expected retrieval metrics under a uniformly random ranking, given gallery size G and number of positives k."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HITS = (1, 3, 5)


def expected_hit(g: int, k: int, at: int) -> float:
    """1 - C(G-k, K)/C(G, K) with K no more than G."""
    at = min(at, g)
    return 1.0 - comb(g - k, at) / comb(g, at)


def expected_mrr(g: int, k: int) -> float:
    """Sum over r of (1/r) C(G-r, k-1)/C(G, k)."""
    whole = comb(g, k)
    return sum(comb(g - r, k - 1) / whole / r for r in range(1, g - k + 2))


#: Euler's constant and the coefficients of 1/n^2, 1/n^4, ... in the expansion of the harmonic numbers.
GAMMA, TAIL = 0.5772156649015329, (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)
#: From here on the expansion is exact to the last digits of a double.
FAR = 20


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n, without a loop; n at least 0."""
    near = F.array(*(F.lit(sum(1 / i for i in range(1, j + 1)) + 0.0) for j in range(FAR)))
    x = n.cast("double")
    tail = F.lit(0.0)
    for c in reversed(TAIL):
        tail = (tail + c) / (x * x)
    return F.when(n < FAR, F.get(near, n.cast("int"))).otherwise(F.log(x) + GAMMA + 1 / (2 * x) + tail)


def expectation_columns(df: DataFrame) -> DataFrame:
    """Adds e_mrr, e_hit1, e_hit3, e_hit5 in closed form, by built-in functions, at the same cost for any G and k.

    The sum over r of C(G-r, k-1)/r is C(G, k-1) (H(G) - H(k-1)), so the expected reciprocal rank is
    k/(G-k+1) (H(G) - H(k-1)); hits are products of at most five ratios.  Null unless 0 < k <= G."""
    g, k = F.col("gallery_size"), F.col("n_positive_keys")
    lawful = (k > 0) & (k <= g)
    added = {"e_mrr": F.when(lawful, k / (g - k + 1) * (harmonic(g) - harmonic(k - 1)))}
    for h in HITS:
        none = F.lit(1.0)
        for i in range(h):  # nothing relevant at rank i + 1 either, as long as there is such a rank
            none = none * F.when(g > i, F.greatest(g - k - i, F.lit(0)) / F.greatest(g - i, F.lit(1))).otherwise(1.0)
        added[f"e_hit{h}"] = F.when(lawful, 1 - none)
    return df.withColumns(added)


def corrected(raw: Column, expected: Column, form: str = "difference") -> Column:
    """raw - E, defined for every gallery, or (raw - E)/(1 - E), null where E is 1."""
    if form == "difference":
        return raw - expected
    if form == "ratio":
        return (raw - expected) / F.nullif(1 - expected, F.lit(0.0))
    raise ValueError(f"unknown correction {form}")
