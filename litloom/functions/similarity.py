"""Vector and string similarity."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distance_to(a: Column, query: list[float]) -> Column:
    """``1 - cos`` to one given vector; null where a vector is null or all zero or the widths differ, so that such rows
    sort last. By Arrow batches whose list column is taken as one matrix: array functions run element by element outside
    generated code, which takes some twenty times as long at usual widths."""
    q = np.asarray(query, dtype=np.float64)
    size = float(np.sqrt((q * q).sum()))

    @F.arrow_udf(T.DoubleType())
    def distance(vectors: pa.Array) -> pa.Array:
        out = np.full(len(vectors), np.nan)
        at = np.flatnonzero(np.asarray(vectors.value_lengths().fill_null(-1)) == len(q))
        if len(at) and size:
            flat = vectors.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(float("nan"))
            x = np.asarray(flat).reshape(len(at), len(q))
            norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * size
            out[at] = 1.0 - np.divide(np.einsum("ij,j->i", x, q), norms, out=np.full(len(at), np.nan), where=norms > 0)
        return pa.array(out, mask=np.isnan(out))

    return distance(a)


def float_cosine(a: Column, b: Column) -> Column:
    """Cosine whose products are rounded to float and summed in double; 0 for a zero vector."""
    n = F.least(F.size(a), F.size(b))

    def product(x: Column, y: Column) -> Column:
        terms = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: (p.cast("float") * q.cast("float")).cast("double"))
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    aa, bb = product(a, a), product(b, b)
    return F.when((aa == 0) | (bb == 0), 0.0).otherwise(product(a, b) / (F.sqrt(aa) * F.sqrt(bb)))


def norm_text(s: str) -> str:
    """Accents dropped, lower case, only a-z and 0-9 left."""
    plain = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c)[0] != "M").lower()
    return "".join(c for c in plain if "a" <= c <= "z" or "0" <= c <= "9")


@F.pandas_udf(T.StringType())
def norm_key(values: pd.Series) -> pd.Series:
    """``norm_text`` of each value; null stays null, a text without Latin letters or digits becomes ''."""
    return values.map(lambda v: None if v is None else norm_text(v))


def jaro(a: str, b: str) -> float:
    """Share of matching characters, corrected for those out of order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    taken: list[tuple[int, str]] = []
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == c:
                free[j] = ""
                taken.append((j, c))
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swapped = sum(x != y for x, (_, y) in zip(mine, sorted(taken))) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro raised by a tenth of what is left for each of up to four equal first characters."""
    base = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return base + prefix * 0.1 * (1 - base)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")
