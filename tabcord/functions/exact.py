"""Floating sums whose bits do not depend on the order of rows.

A double is a whole number of up to 53 bits times a power of two.  Its bits are
dealt to bins of 24 bits by exponent, each bin's share being a small whole
number; the shares are summed as longs, which is exact and combines in any order
over any partitioning, for up to 2**39 rows.  At the end the bins of a group are
carried into one whole number, which is rounded once: the result is the exact
sum of the given doubles, correctly rounded.  Only built-in functions are used,
so aggregation stays a hash aggregate.

Which bins are needed follows from the smallest and the largest magnitude of a
column, found in one pass over the data.  NaN counts as missing, infinities act
as in any sum.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import aggregate_to_long, col

WIDTH = 24
ROOM = 62
#: Binary place of the lowest bit a double can have, and of the lowest bin; the highest bin.
BASE, MOST = -1074, 87


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != math.inf), value)


def _unit(k: int) -> float:
    return math.ldexp(1.0, WIDTH * k + BASE) if k <= MOST else math.inf


def share_of(value: Column, k: int) -> Column:
    """The part of a finite value that falls into a bin, in units of the bin."""
    within = value % F.lit(_unit(k + 1)) if k < MOST else value
    return (within / F.lit(_unit(k))).cast("long")


def _shift(name: str, value: Column, by: Column | int) -> Column:
    return F.call_function(name, value, F.lit(by) if isinstance(by, int) else by.cast("int"))


def carried(sums: Column) -> Column:
    """(carry, digits): the sums of bins, lowest first, as digits of 24 bits and what is above."""
    start = F.struct(
        F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("digits")
    )

    def step(acc: Column, s: Column) -> Column:
        v = acc["carry"] + s
        digit = v.bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))
        return F.struct(
            _shift("shiftright", v, WIDTH).alias("carry"),
            F.concat(acc["digits"], F.array(digit)).alias("digits"),
        )

    return F.aggregate(sums, start, step)


def rounded(digits: Column, low: int) -> Column:
    """The double nearest to a number given by its digits, lowest first, from bin ``low``."""
    first = F.size(digits) - 1 + F.lit(low)
    start = F.struct(
        F.lit(0).cast("long").alias("top"),
        F.lit(0).alias("bits"),
        F.lit(0).alias("at"),
        F.lit(False).alias("full"),
        F.lit(False).alias("rest"),
        first.cast("int").alias("k"),
    )

    def step(acc: Column, d: Column) -> Column:
        top, bits, full = acc["top"], acc["bits"], acc["full"]
        free = F.lit(ROOM) - bits
        fits = ~full & (free >= WIDTH)
        cut = F.lit(WIDTH) - free
        taken = _shift("shiftleft", top, free).bitwiseOR(_shift("shiftright", d, cut))
        left = d.bitwiseAND(_shift("shiftleft", F.lit(1).cast("long"), cut) - 1)
        size = F.when(top > 0, bits + WIDTH).when(d > 0, F.length(F.bin(d))).otherwise(0)
        return F.struct(
            F.when(fits, _shift("shiftleft", top, WIDTH).bitwiseOR(d))
            .when(full, top)
            .otherwise(taken)
            .alias("top"),
            F.when(fits, size).otherwise(bits).cast("int").alias("bits"),
            F.when(fits, acc["k"] * WIDTH)
            .when(full, acc["at"])
            .otherwise(acc["k"] * WIDTH + cut)
            .cast("int")
            .alias("at"),
            (full | ~fits).alias("full"),
            (acc["rest"] | F.when(fits, False).when(full, d != 0).otherwise(left != 0)).alias(
                "rest"
            ),
            (acc["k"] - 1).cast("int").alias("k"),
        )

    def value(acc: Column) -> Column:
        whole = _shift("shiftleft", acc["top"], 1).bitwiseOR(acc["rest"].cast("long"))
        place = acc["at"] + (BASE - 1)
        half = F.floor(place / 2)  # two steps, so that neither leaves the range of doubles
        power = lambda n: F.pow(F.lit(2.0), n.cast("double"))
        return whole.cast("double") * power(half) * power(place - half)

    return F.aggregate(F.reverse(digits), start, step, value)


class ExactSums:
    """Exact sums of floating expressions over a table, as parts of any group-by.

    ``values`` names the expressions to sum.  :meth:`parts` are the aggregates
    of a grouping of the table, :meth:`again` those of a coarser grouping of
    its result, and :meth:`result` is the sum over what either gave.
    """

    def __init__(self, df: DataFrame, values: Mapping[str, Column]):
        self.values = {n: v.cast("double") for n, v in values.items()}
        self.bins: dict[str, tuple[int, int]] = {}
        if not values:
            return

        def row(name: str) -> Column:
            size = F.abs(_finite(self.values[name]))
            return F.struct(
                F.lit(name).alias("name"),
                F.min(F.when(size > 0, size)).alias("least"),
                F.max(size).alias("most"),
            )

        for r in aggregate_to_long(df, [row(n) for n in self.values]).collect():
            low = math.frexp(r["least"])[1] - 53 if r["least"] else 0
            high = math.frexp(r["most"])[1] if r["most"] else 0
            low, high = (max(0, v - BASE) // WIDTH for v in (low, high))
            self.bins[r["name"]] = (low, min(MOST, high))

    def _names(self, name: str) -> list[str]:
        low, high = self.bins[name]
        return [f"{name}__{k - low}" for k in range(low, high + 1)]

    def parts(self) -> list[Column]:
        out = []
        for name, value in self.values.items():
            low, finite = self.bins[name][0], _finite(value)
            for i, part in enumerate(self._names(name)):
                out.append(F.sum(share_of(finite, low + i)).alias(part))
            odd = F.sum(F.when(F.abs(value) == math.inf, value))
            out.append(odd.alias(f"{name}__odd"))
            out.append(F.count(F.when(~F.isnan(value), value)).alias(f"{name}__n"))
        return out

    def again(self) -> list[Column]:
        return [
            F.sum(col(part)).alias(part)
            for name in self.values
            for part in [*self._names(name), f"{name}__odd", f"{name}__n"]
        ]

    def count(self, name: str) -> Column:
        """How many values were summed."""
        return col(f"{name}__n")

    def result(self, name: str) -> Column:
        """The sum, correctly rounded; null over no value."""
        low = self.bins[name][0]
        shares = [F.coalesce(col(part), F.lit(0).cast("long")) for part in self._names(name)]
        zero = F.lit(0).cast("long")
        up = carried(F.array(*shares, zero, zero))
        down = carried(F.array(*[-s for s in shares], zero, zero))
        whole = F.when(up["carry"] < 0, -rounded(down["digits"], low)).otherwise(
            rounded(up["digits"], low)
        )
        total = F.coalesce(col(f"{name}__odd"), whole)
        return F.when(col(f"{name}__n") > 0, total)


def exact_sums(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], rows_as: str | None = None
) -> DataFrame:
    """Sums of floating columns per group, equal in every bit under any partitioning."""
    sums = ExactSums(df, {f"v{i}": col(c) for i, c in enumerate(columns)})
    counted = [F.count(F.lit(1)).alias("n__rows")] if rows_as else []
    keys = [f"k{i}" for i in range(len(by))]
    grouped = df.groupBy(*[col(c).alias(k) for c, k in zip(by, keys, strict=True)])
    return grouped.agg(*sums.parts(), *counted).select(
        *[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)],
        *[sums.result(f"v{i}").alias(c) for i, c in enumerate(columns)],
        *[F.col("n__rows").alias(rows_as) for _ in counted],
    )
