"""Token-set similarity of two names, 0 to 100, as a vectorised UDF; Spark has no built-in for it.

The measure compares sets of words: what both share, and what is left on either side, sorted and
joined; differences count insertions and deletions only.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the first text."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=100_000)
def token_set_ratio(left: str, right: str) -> float:
    """Similarity of normalised names; 0 if either has no word."""
    a, b = set(left.split()), set(right.split())
    if not a or not b:
        return 0.0
    both = a & b
    if both and (a <= b or b <= a):
        return 100.0
    only_a, only_b = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    shared = len(" ".join(both))
    gap = 1 if shared else 0
    len_a, len_b = shared + gap + len(only_a), shared + gap + len(only_b)
    apart = len(only_a) + len(only_b) - 2 * common_subsequence(only_a, only_b)
    best = 100 - 100 * apart / (len_a + len_b)
    if shared:
        best = max(best, 100 - 100 * (gap + len(only_a)) / (shared + len_a), 100 - 100 * (gap + len(only_b)) / (shared + len_b))
    return best


@F.arrow_udf(DoubleType())
def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    """``token_set_ratio`` of two columns; null if either is null."""
    return pa.array([None if a is None or b is None else token_set_ratio(a, b) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())
