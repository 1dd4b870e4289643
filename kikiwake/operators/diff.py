"""Token-level diff: the one Arrow UDF of the core, since Catalyst has no sequence alignment.

Linear-space shortest edit script (Myers 1986) over surfaces; runs between equal stretches become replace, insert or delete blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from ..types import BLOCK


def matches(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i < j and k < m:
            x, y, u, v = _middle(a, b, i, j, k, m)
            out += zip(range(x, u), range(y, v))
            if (x, y) != (j, m) and (u, v) != (i, k):
                todo += [(i, x, k, y), (u, j, v, m)]
    return sorted(out)


def _middle(a: Sequence, b: Sequence, i: int, j: int, k: int, m: int) -> tuple[int, int, int, int]:
    """A snake in the middle of a shortest script between a[i:j] and b[k:m]."""
    n, w = j - i, m - k
    delta, odd = n - w, (n - w) % 2
    ahead, behind = {1: 0}, {1: 0}
    for d in range((n + w + 1) // 2 + 1):
        for q in range(-d, d + 1, 2):
            x = ahead.get(q + 1, -1) if q == -d or (q != d and ahead.get(q - 1, -1) < ahead.get(q + 1, -1)) else ahead[q - 1] + 1
            y = x - q
            x0, y0 = x, y
            while x < n and y < w and a[i + x] == b[k + y]:
                x, y = x + 1, y + 1
            ahead[q] = x
            if odd and -(d - 1) <= delta - q <= d - 1 and x + behind.get(delta - q, -n - w) >= n:
                return i + x0, k + y0, i + x, k + y
        for q in range(-d, d + 1, 2):
            x = behind.get(q + 1, -1) if q == -d or (q != d and behind.get(q - 1, -1) < behind.get(q + 1, -1)) else behind[q - 1] + 1
            y = x - q
            x0, y0 = x, y
            while x < n and y < w and a[j - x - 1] == b[m - y - 1]:
                x, y = x + 1, y + 1
            behind[q] = x
            if not odd and -d <= delta - q <= d and x + ahead.get(delta - q, -n - w) >= n:
                return j - x, m - y, j - x0, m - y0
    return j, m, j, m


def opcodes(a: Sequence, b: Sequence) -> Iterator[tuple[str, int, int, int, int]]:
    """(tag, i1, i2, j1, j2) in order; a replace is a gap with tokens on both sides."""
    i = j = 0
    run = None
    for x, y in [*matches(a, b), (len(a), len(b))]:
        if (x, y) != (i, j):
            if run:
                yield ("equal", *run)
            yield ("replace" if x > i and y > j else "delete" if x > i else "insert", i, x, j, y)
            run = None
        if x < len(a):
            run = (run[0], x + 1, run[2], y + 1) if run else (x, x + 1, y, y + 1)
        i, j = x + 1, y + 1
    if run:
        yield ("equal", *run)


def _cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for r, h in parts:
        out = []
        for x, y in zip(r, h):
            x, y = list(x) if x is not None else [], list(y) if y is not None else []
            ops = opcodes([t["surface"] for t in x], [t["surface"] for t in y])
            out.append([{"tag": t, "reference": x[a:b], "hypothesis": y[c:d]} for t, a, b, c, d in ops if t in ("equal", "replace")])
        yield pd.Series(out, dtype=object)


def diff_rows(reference: Column, hypothesis: Column) -> Column:
    """Equal and replace blocks in order; a null side counts as empty."""
    # not made when the module is loaded: workers load it, too, and have no session
    return F.pandas_udf(_cut, f"array<{BLOCK}>", PandasUDFType.SCALAR_ITER)(reference, hypothesis)


def replacements(reference: Column, hypothesis: Column) -> Column:
    """Replace blocks in order."""
    return F.filter(diff_rows(reference, hypothesis), lambda b: b["tag"] == "replace")
