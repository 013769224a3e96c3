"""Joins that make far more pairs than they have rows, dealt out: a task gets a cell, which is some rows of either side.

Cells are chosen by counts that are asked for first, where the tables are so large that it can matter. Each pair of rows
meets in one cell; a row is copied to as many as it needs, about the square root of the pairs that a cell holds.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relation as R
from .relation import Relation

#: Pairs of a cell.
PAIRS = 10_000_000
#: Product of both sides' bytes (as Catalyst estimates them) from which counts are asked for.
LARGE = 10**10
#: Ranges of a side, partitions of a join.
MOST_RANGES, MOST_PARTITIONS = 512, 2000
#: Part by which the largest and smallest value are widened: a sum of doubles may differ when it is made again.
MARGIN = 1e-9


def _large(left: Relation, right: Relation) -> bool:
    size = lambda r: int(str(r.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return not (left.df.isStreaming or right.df.isStreaming) and size(left) * size(right) > LARGE


def _key(left: Relation, right: Relation, v: str) -> str | None:
    """SQL of a shared variable's key, of one type on both sides and compared as it is; None where there is none."""
    kinds = {dict(r.df.dtypes)[v] for r in (left, right)}
    x, y = left.vars[v], right.vars[v]
    if x.nullable or y.nullable or x.kind == "term" or not x.same_shape(y):
        return None
    if kinds <= {"tinyint", "smallint", "int", "bigint"}:
        return f"CAST(`{v}` AS BIGINT)"
    if kinds <= {"float", "double"}:  # as text: Spark wraps doubles before it compares them, and would deal rows out anew
        return f"CAST(CAST(`{v}` AS DOUBLE) + 0D AS STRING)"
    return f"`{v}`" if len(kinds) == 1 else None


def _spread(r: Relation, df: DataFrame) -> DataFrame:
    """With a hash of each row, by which rows are dealt over tasks, so that no task copies all of a small file's rows."""
    df = df.withColumn("..hash", F.xxhash64(*[r.col(v) for v in r.vars]))
    return df.repartition(int(r.spark.conf.get("spark.sql.shuffle.partitions")), "`..hash`")


def _met(left: Relation, right: Relation, a: DataFrame, b: DataFrame, keys: list[str], cells: float) -> Relation:
    """The pairs that meet in `..cell`, with equal keys (in SQL)."""
    n = min(MOST_PARTITIONS, max(math.ceil(cells), int(left.spark.conf.get("spark.sql.shuffle.partitions"))))
    names = [f"..key{k}" for k in range(len(keys))]
    dealt = [*[F.expr(k).alias(x) for k, x in zip(keys, names)], F.col("`..cell`")]
    a = a.select(*[left.col(v) for v in left.vars], *dealt).repartition(n, *[f"`{x}`" for x in names], "`..cell`")
    b = b.select(*[right.col(v).alias(f"..{v}") for v in right.vars], *dealt).repartition(n, *[f"`{x}`" for x in names], "`..cell`")
    return R._merged(a.join(b.hint("merge"), [*names, "..cell"]), left, right, False)


def join(left: Relation, right: Relation) -> Relation:
    """relation.join (a product without shared variables), dealt out where keys that both sides repeat make many pairs."""
    keys = [v for v in left.vars if v in right.vars]
    compared = [_key(left, right, v) for v in keys]
    if None in compared or any(v in left.keys or v in right.keys for v in keys) or not _large(left, right):
        return R.join(left, right)
    count = lambda r, name: r.df.groupBy(*[r.col(v) for v in keys]).agg(F.count(F.lit(1)).cast("double").alias(name))
    both = count(left, "..n").join(count(right, "..m"), keys) if keys else count(left, "..n").crossJoin(count(right, "..m"))
    n, m, side = F.col("`..n`"), F.col("`..m`"), F.lit(PAIRS**0.5)
    split = F.struct(*[F.col(f"`{v}`") for v in keys], F.ceil(n / F.greatest(side, PAIRS / m)).alias("..n"), F.ceil(m / F.greatest(side, PAIRS / n)).alias("..m"))
    made = both.where((n > 0) & (m > 0)).agg(F.sum(n * m).alias("pairs"), F.collect_list(F.when(n * m > PAIRS, split)).alias("split"))
    pairs, found = made.first()  # keys that are split: pairs / PAIRS at most
    if (pairs or 0) <= PAIRS:
        return R.join(left, right)
    schema = made.schema["split"].dataType.elementType
    sides = []
    for r in (left, right):
        df = _spread(r, r.df)
        if found:
            parts = F.broadcast(left.spark.createDataFrame(found, schema))
            df = df.join(parts, keys, "left") if keys else df.crossJoin(parts)
        else:
            df = df.withColumns({"..n": F.lit(1), "..m": F.lit(1)})
        a, b = (F.coalesce(F.col(f"`{c}`"), F.lit(1)).cast("long") for c in ("..n", "..m"))
        own = F.pmod(F.col("`..hash`"), a if r is left else b)
        sides.append(df.withColumn("..cell", F.explode(F.sequence(own * b, own * b + b - 1) if r is left else F.sequence(own, (a - 1) * b + own, b))))
    return _met(left, right, *sides, compared, pairs / PAIRS)


class _Ranges:
    """Ranges of about as many rows each, in order; a value that fills several of them is dealt over these by its row's hash."""

    def __init__(self, bounds: list[float]):
        """bounds: the largest value of each range but the last."""
        bounds = [b for b in bounds if b == b]  # NaN comes after all
        times = Counter(bounds)
        self.bounds = sorted(times)
        self.starts = [sum(times[b] for b in self.bounds[:k]) for k in range(len(self.bounds) + 1)] + [len(bounds) + 1]
        self.number = len(bounds) + 1

    def _start(self, c: Column, after: int = 0) -> Column:
        lower = F.size(F.filter(F.lit(self.bounds), lambda b: b < c)) if self.bounds else F.lit(0)
        return F.get(F.lit(self.starts), lower + after).cast("long")

    def first(self, c: Column) -> Column:
        return self._start(c)

    def last(self, c: Column) -> Column:
        return self._start(c, 1) - 1

    def own(self, c: Column, row: Column) -> Column:
        return self.first(c) + F.pmod(row, self.last(c) - self.first(c) + 1)


def reversed_order(c: Column) -> Column:
    """NaN, which Spark puts after all numbers, comes first."""
    return F.when(F.isnan(c), F.lit(float("-inf"))).otherwise(-c)


def range_join(left: Relation, right: Relation, x: Column, y: Column) -> Relation:
    """The product without most pairs of which x (of the left side, a double) > y (of the right one).

    Ranges of x and of y form a grid; a row is copied to the cells that can hold pairs of it.
    """
    if not _large(left, right):
        return R.join(left, right)
    a, b = left.df.withColumn("..x", x), right.df.withColumn("..x", y)
    c = F.col("`..x`")
    low, high = a.agg(F.min(c)).first()[0], b.agg(F.max(c)).first()[0]
    if low is None or high is None:  # no pair at all
        a, n, m = a.where(F.lit(False)), 0, 0
    else:
        a, b = a.where(c <= F.lit(high + abs(high) * MARGIN)), b.where(c >= F.lit(low - abs(low) * MARGIN))
        n, m = a.count(), b.count()
    if n * m <= PAIRS:
        return R.join(Relation(a, left.vars), Relation(b, right.vars))
    ranges = []
    for df, k in ((a, n / max(PAIRS**0.5, PAIRS / m)), (b, m / max(PAIRS**0.5, PAIRS / n))):
        k = min(MOST_RANGES, math.ceil(k))
        ranges.append(_Ranges(df.agg(F.percentile_approx(c, [i / k for i in range(1, k)], 20 * k)).first()[0] if k > 1 else []))
    of_x, of_y = ranges
    wide = F.lit(of_y.number).cast("long")
    row = F.col("`..hash`")
    own_x, own_y = of_x.own(c, row) * wide, of_y.own(c, row)
    a, b = _spread(left, a), _spread(right, b)
    a = a.withColumn("..cell", F.explode(F.sequence(own_x + of_y.first(c), own_x + wide - 1)))
    b = b.withColumn("..cell", F.explode(F.sequence(own_y, of_x.last(c) * wide + own_y, wide)))
    return _met(left, right, a, b, [], of_x.number * of_y.number)
