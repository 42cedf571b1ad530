"""Counter-based random numbers: a draw is a function of a seed, a stream name and key columns, so that it does not
depend on partitioning and any SQL engine can recompute it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seed that callers get if they name none.
DEFAULT_SEED = 314159
_RANGE = 4294967296.0


def _bits(seed: int | Column, stream: str, *keys: Column | str) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", seed.cast("string"), F.lit(stream), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")


def uniform(seed: int | Column, stream: str, *keys: Column | str) -> Column:
    """A number in [0, 1) with 32 random bits."""
    return _bits(seed, stream, *keys) / _RANGE


def normal(seed: int | Column, stream: str, *keys: Column | str) -> Column:
    """A standard normal number by the Box-Muller transform of two uniform ones."""
    one = (_bits(seed, stream + "1", *keys) + 0.5) / _RANGE
    two = (_bits(seed, stream + "2", *keys) + 0.5) / _RANGE
    return F.sqrt(-2.0 * F.log(one)) * F.cos(2 * math.pi * two)
