"""Sizes and forms chosen before a plan is built: tiles from an element budget, the physical form of a product."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_sizes(n: int, m: int, k: int, budget: int | None, align: int = 32) -> tuple[int, int, int]:
    """(rows, cols, depth) of tiles of an n x k by k x m product with `budget` elements a chunk (3 at least): a third for output, the rest for both inputs,
    sizes cut down to multiples of `align` where they reach it and held within the matrix. Without a budget at most 256 each."""
    if budget is None:
        return min(n, 256), min(m, 256), min(k, 256)
    budget = max(3, budget)
    out = max(1, budget // 3)
    fit = lambda size, most: max(size - size % align, 0) or min(most, 1)
    cols = fit(min(m, max(1, isqrt(out))), m)
    rows = fit(min(n, max(1, out // cols)), n)
    deep = max(1, budget - out) // max(1, rows + cols)
    depth = min(k, max(1, deep - deep % align))
    return rows, cols, depth


def tile_columns(n: Column, m: Column, k: Column, budget: Column, align: int = 32) -> dict[str, Column]:
    """The same as expressions, for plans over many products."""
    budget = F.greatest(budget, F.lit(3))
    out = F.greatest(F.lit(1), F.floor(budget / 3))
    cut = lambda size, most: F.when(size >= align, size - size % align).otherwise(F.least(most, F.lit(1)))
    cols = cut(F.least(m, F.greatest(F.lit(1), F.floor(F.sqrt(out)))), m)
    rows = cut(F.least(n, F.greatest(F.lit(1), F.floor(out / cols))), n)
    deep = F.floor(F.greatest(F.lit(1), budget - out) / F.greatest(F.lit(1), rows + cols))
    depth = F.least(k, F.greatest(F.lit(1), deep - deep % align))
    up = lambda a, b: F.ceil(a / b)
    made = {"rows": rows, "cols": cols, "depth": depth, "chunks": up(n, rows) * up(m, cols) * up(k, depth)}
    return {name: c.cast("long") for name, c in made.items()}


def form(n: int, m: int, k: int, filled: float, small: int = 1 << 22) -> str:
    """The physical form of a product: cells while the pairs to be joined are few or the matrices sparse, tiles beyond."""
    return "cells" if n * m * k * filled * filled <= small else "tiles"
