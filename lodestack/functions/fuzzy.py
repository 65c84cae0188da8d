"""Fuzzy string likeness, 0 to 100, as Arrow-batched UDFs over a bit-parallel longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one bit per character of ``a`` in a Python integer."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel(a: str, b: str) -> float:
    """200 x LCS / total length; 100 for two empty strings."""
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * lcs(a, b) / n


def token_set(a: str | None, b: str | None) -> float:
    """Likeness of two names by their sets of words: the best of common words against each side, and of the sides."""
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [indel(one, two)]
    if both:
        scores += [indel(both, one), indel(both, two)]
    return max(scores)


def partial(a: str | None, b: str | None) -> float:
    """Best likeness of the shorter string with a window of the longer, windows shorter at its ends included."""
    if not a or not b:
        return 0.0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if short in long_:
        return 100.0
    n, letters, best = len(short), set(short), 0.0
    for i in range(-n + 1, len(long_)):
        window = long_[max(0, i) : i + n]
        # a window that begins or ends with a letter the needle lacks is beaten by a neighbour
        if i > 0 and window[-1] not in letters or not window:
            continue
        best = max(best, indel(short, window))
    return best


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial(x, y) for x, y in zip(a, b)], dtype="float64")
