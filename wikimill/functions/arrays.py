"""Arrays to rows, and array helpers whose cost grows with the length of the array and not with its square."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import let


def rows_of(df: DataFrame, keep: list[str | Column], array: Column, item: str, pos: str | None = None) -> DataFrame:
    """One row per array item, with its position when ``pos`` is given; empty arrays give no row.

    Before a plain explode the optimizer tests the array for emptiness in a filter further down, which computes a long
    array expression again and again. The outer form with a filter above it computes the array once.
    """
    at = pos or "_at"
    d = df.select(*keep, F.posexplode_outer(array).alias(at, item)).where(F.col(at).isNotNull())
    return d if pos else d.drop(at)


STRIDE = 64


def _sums(values: Column) -> Column:
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def running_sums(values: Column) -> Column:
    """Sum of an int array up to and with each item. Stretches are summed on their own, then raised by those before them."""

    def raised(parts: Column) -> Column:
        ends = _sums(F.transform(parts, lambda p: F.coalesce(F.get(p, F.size(p) - 1), F.lit(0))))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: x + F.coalesce(F.get(e, i - 1), F.lit(0))))))

    def stretches(v: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(STRIDE))
        return let(F.transform(at, lambda s: _sums(F.slice(v, s + 1, F.lit(STRIDE)))), raised)

    return let(values, stretches)


def rest(items: Column) -> Column:
    """All items but the first."""
    return let(items, lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))))


def first_per(items: Column, field: str) -> Column:
    """The first struct of each value of ``field`` in an array, in order: by one sort on the value and one on the place."""
    tagged = F.transform(items, lambda x, i: F.struct(x[field].alias("k"), i.alias("i"), x.alias("x")))

    def heads(s: Column) -> Column:
        kept = F.filter(s, lambda t, j: (j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(t["k"]))
        return F.transform(F.array_sort(F.transform(kept, lambda t: F.struct(t["i"].alias("i"), t["x"].alias("x")))), lambda t: t["x"])

    return let(F.array_sort(tagged), heads)


def counts_below(marks: Column, points: Column, or_at: bool = False) -> Column:
    """For each of the ascending ``points`` the number of ascending ``marks`` below it (or at it). Both are sorted together once; a
    point's place among all less its place among the points is what lies below."""
    point = 1 if or_at else 0
    both = F.concat(F.transform(marks, lambda m: F.struct(m.alias("at"), F.lit(1 - point).alias("kind"))), F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(point).alias("kind"))))

    def places(s: Column) -> Column:
        return F.filter(F.transform(s, lambda x, j: F.struct(x["kind"].alias("kind"), j.alias("j"))), lambda x: x["kind"] == point)

    return F.transform(let(F.sort_array(both), places), lambda x, i: x["j"] - i)
