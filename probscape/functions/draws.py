"""Seeded pseudo-random columns: a draw depends on its keys only, never on partitioning."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = float(1 << 53)


class Draws:
    """Uniform, normal and integer draws on top of one uniform source."""

    def uniform(self, label: str, *keys: Column) -> Column:
        """In [0, 1), independent for different labels."""
        raise NotImplementedError

    def normal(self, label: str, *keys: Column) -> Column:
        """Standard normal, from two uniforms."""
        u, v = self.uniform(f"{label}.r", *keys), self.uniform(f"{label}.a", *keys)
        return F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(2.0 * math.pi * v)

    def integer(self, label: str, n: Column, *keys: Column) -> Column:
        """1 … n."""
        return (F.floor(self.uniform(label, *keys) * n) + 1).cast("int")


@dataclass(frozen=True)
class HashDraws(Draws):
    seed: int = 0

    def uniform(self, label: str, *keys: Column) -> Column:
        h = F.xxhash64(F.lit(self.seed), F.lit(label), *keys)
        return F.shiftrightunsigned(h, 11).cast("double") / _RANGE
