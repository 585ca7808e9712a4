"""Numbers that look drawn at random, from a public hash: the same in every run, task and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 48


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1): the first 48 bits of the MD5 of ``seed:part:part...``, plus a half, over 2**48."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("double") + 0.5) / float(2**BITS)
