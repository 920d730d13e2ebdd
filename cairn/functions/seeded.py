"""Random choices that depend on a key and a seed only: the same on every cluster, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(key: Column | str, seed: str | int = "") -> Column:
    """md5 hex of ``key:seed``; sorting by it is a seeded random permutation."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def uniform(key: Column | str, seed: str | int = "") -> Column:
    """A number in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(key: str, seed: str | int = "") -> str:
    """The same number in DuckDB SQL."""
    return f"(('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
