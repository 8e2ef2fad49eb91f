"""Folds over an array that give one result per element.

A fold that appends to an array copies it at each step. Here only a chunk's results are appended one by one; chunks' results
are appended as a whole, and those of chunks of chunks. So the time follows the length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64
LEVELS = 2


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], out_type: str, chunk: int | None = None) -> Column:
    """The results ``o`` of ``step(state, item)``, a struct of the next state ``s`` and ``o``, along ``items``; ``start`` is the first
    state. Arrays of up to ``chunk`` elements, nearly all there are, are folded at once."""
    chunk = chunk or CHUNK

    def bound(value: Column, use) -> Column:
        """An expression that is used twice would be computed twice."""
        return F.transform(F.array(value), use)[0]

    def folded(xs: Column, state: Column, level: int) -> Column:
        """Struct of the last state and the results."""
        if not level:
            begin = F.struct(state.alias("s"), F.array().cast(f"array<{out_type}>").alias("o"))
            return F.aggregate(xs, begin, lambda acc, x: bound(step(acc["s"], x), lambda r: F.struct(
                r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"].cast(out_type))).alias("o"))))
        size = chunk ** level
        places = F.filter(F.sequence(F.lit(0), F.size(xs), F.lit(size)), lambda k: k < F.size(xs))
        parts = F.transform(places, lambda k: F.slice(xs, k + 1, size))
        begin = F.struct(state.alias("s"), F.array().cast(f"array<array<{out_type}>>").alias("o"))
        return F.aggregate(
            parts, begin,
            lambda acc, part: bound(folded(part, acc["s"], level - 1), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o"))),
            lambda acc: F.struct(acc["s"].alias("s"), F.flatten(acc["o"]).alias("o")),
        )

    return F.when(F.size(items) <= chunk, folded(items, start, 0)["o"]).otherwise(folded(items, start, LEVELS)["o"])
