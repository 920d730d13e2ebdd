"""Variable-byte coding of integer lists: base-128 groups, most significant first, the last byte of a number marked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: 7-bit groups of a 63-bit number.
GROUPS = 9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _byte(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def number_hex(n: Column) -> Column:
    """Hex of one non-negative number."""
    n = n.cast("bigint")
    parts = [F.when(F.shiftright(n, 7 * g) > 0, _byte(F.shiftright(n, 7 * g).bitwiseAND(127))).otherwise(F.lit("")) for g in range(GROUPS - 1, 0, -1)]
    return F.concat(*parts, _byte(n.bitwiseAND(127).bitwiseOR(128)))


def encode(numbers: Column | str) -> Column:
    """Count and numbers as bytes; null for an empty or null list."""
    xs = _col(numbers)
    body = F.concat(number_hex(F.size(xs)), F.array_join(F.transform(xs, number_hex), ""))
    return F.when(F.size(xs) > 0, F.unhex(body))


def _decode(data: bytes) -> np.ndarray:
    """All numbers of a byte string, the count included; bytes after the last marked one are no number."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw >= 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    raw = raw[: ends[-1] + 1].astype(np.int64)
    place = np.repeat(ends, ends - starts + 1) - np.arange(len(raw))  # groups still to come in the number
    return np.add.reduceat((raw & 127) << (7 * place), starts)


def _listed(kernel):
    """A pandas UDF that maps each value of a column to a list of integers; null stays null. Linear in the value."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else kernel(v) for v in values], dtype=object)

    return F.pandas_udf(run, ArrayType(LongType()))


_numbers = _listed(lambda data: _decode(data)[1:] if len(data) else None)
_running = _listed(lambda xs: np.cumsum(np.asarray(xs, dtype=np.int64)))
_both = _listed(lambda data: np.cumsum(_decode(data)[1:]) if len(data) else None)


def decode(data: Column | str) -> Column:
    """The numbers of an encoded list (without the count); null and no bytes give null."""
    return _numbers(_col(data))


def gaps(numbers: Column | str) -> Column:
    """First differences of a sorted list; the first gap is the first value."""
    xs = _col(numbers)
    return F.transform(xs, lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at(xs, F.greatest(i, F.lit(1)))))


def prefix_sums(numbers: Column | str) -> Column:
    """The inverse of ``gaps``; null stays null."""
    return _running(_col(numbers).cast("array<bigint>"))


def compress(numbers: Column | str) -> Column:
    """Gap coding, then variable bytes."""
    return encode(gaps(numbers))


def decompress(data: Column | str) -> Column:
    """The inverse of ``compress``."""
    return _both(_col(data))
