"""String similarities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler with prefix weight 0.1 over 4 characters, boosted only above a Jaro of 0.7.

    An empty side is similar to nothing, not even to another empty one.
    """
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    mine = []
    places = []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), i + reach + 1)
        while j >= 0 and not free[j]:
            j = b.find(c, j + 1, i + reach + 1)
        if j >= 0:
            free[j] = False
            mine.append(c)
            places.append(j)
    m = len(mine)
    if not m:
        return 0.0
    places.sort()
    crossed = sum(c != b[j] for c, j in zip(mine, places, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - crossed) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the table is one integer."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null if a side is null, so that rows decided otherwise cost nothing."""
    known: dict = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = jaro_winkler_of(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="Float64")


@F.pandas_udf(T.DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="Float64")


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Share of characters in the longest common subsequence of the sorted tokens, in [0, 1]."""
    return _indel(sorted_tokens(a), sorted_tokens(b))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
