"""Two string scorers after their public definitions, as Arrow-batched functions.

ratio is the normalised insert/delete similarity 200*LCS/(m+n). The others combine it over
sorted tokens, token sets and best-aligned parts of the longer string.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    if not total:
        return 100.0
    if a == b:
        return 100.0
    return 200.0 * _lcs(a, b) / total


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence with one machine integer per string (bit-parallel)."""
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & places.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string against any stretch of the longer, ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m = len(short)
    if not m:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    stretches = {long[max(0, i) : i + m] for i in range(1 - m, len(long))}
    best = max(ratio(short, part) for part in stretches)
    if len(a) == len(b):
        best = max(best, max(ratio(long, short[max(0, i) : i + m]) for i in range(1 - m, m)))
    return best


def _token_parts(a: str, b: str) -> tuple[str, str, str]:
    left, right = set(a.split()), set(b.split())
    return (
        " ".join(sorted(left & right)), " ".join(sorted(left - right)), " ".join(sorted(right - left))
    )


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    common, only_a, only_b = _token_parts(a, b)
    if common and (not only_a or not only_b):
        return 100.0
    best = ratio(f"{common} {only_a}".strip(), f"{common} {only_b}".strip())
    if common:
        best = max(best, ratio(common, f"{common} {only_a}"), ratio(common, f"{common} {only_b}"))
    return best


def _sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_ratio(a: str, b: str) -> float:
    return max(ratio(_sorted_tokens(a), _sorted_tokens(b)), token_set_ratio(a, b))


def partial_token_ratio(a: str, b: str) -> float:
    common, only_a, only_b = _token_parts(a, b)
    if common:
        return 100.0
    return max(partial_ratio(_sorted_tokens(a), _sorted_tokens(b)), partial_ratio(only_a, only_b))


def weighted_ratio(a: str, b: str) -> float:
    """Plain ratio for strings of like length, part ratios (scaled down) for unlike ones."""
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    score = ratio(a, b)
    if spread < 1.5:
        return max(score, token_ratio(a, b) * 0.95)
    part = 0.9 if spread <= 8.0 else 0.6
    return max(score, partial_ratio(a, b) * part, partial_token_ratio(a, b) * 0.95 * part)


@F.pandas_udf(DoubleType())
def weighted_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")
