"""Keyed uniform draws: a pure function of (seed, index, stream), whatever the partitioning.

``uniform`` is a Catalyst expression over md5. ``pcg`` is the numpy generator keyed the
same way, for sequential draws on executors. The two are different streams: use one
kind within an experiment.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(1 << 52)


def _digest(seed: int | Column, index: Column | str, stream: str | Column) -> Column:
    parts = [F.lit(seed) if isinstance(seed, int) else seed, F.col(index) if isinstance(index, str) else index, F.lit(stream) if isinstance(stream, str) else stream]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def uniform(seed: int | Column, index: Column | str, stream: str | Column) -> Column:
    """In [0, 1): the first 52 bits of md5('seed|index|stream')."""
    return F.conv(F.substring(_digest(seed, index, stream), 1, 13), 16, 10).cast("long") / F.lit(_SCALE)


def below(seed: int | Column, index: Column | str, stream: str | Column, p: float) -> Column:
    """uniform(...) < p for a fixed p, told by comparing hexadecimal digits: no number is made."""
    least = math.ceil(p * _SCALE)
    if least <= 0 or least >= 1 << 52:
        return F.lit(least > 0)
    return _digest(seed, index, stream) < f"{least:013x}"


def pcg(seed: int, index: int, stream: str) -> np.random.Generator:
    return np.random.default_rng([seed, index, zlib.crc32(stream.encode())])


def normal(seed: int, index: Column | str, stream: str) -> Column:
    """Standard normal by Box-Muller on two keyed uniforms."""
    u, v = uniform(seed, index, f"{stream}:u"), uniform(seed, index, f"{stream}:v")
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2 * np.pi * v)
