"""Exact quantiles of groups of any size, in two passes.

The first pass keeps a sketch of each group, of fixed size.  It gives two values
between which a quantile's rank must lie, whatever the distribution is.  The second
pass counts what lies below them, as one number, and puts in order only what lies
between: about a thousandth of a large group.  So no task sorts or holds the values
of a whole group; small groups are put in order whole.  That the rank does lie
between the two values is checked with the exact counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Groups of no more values are put in order whole.
WHOLE = 10_000
#: Values are kept within so much of a share on both sides, and the sketch errs by less than a fifth of that.
_MARGIN, _ACCURACY = 5e-4, 10_000


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which a null equals a null; the keys appear once."""
    names = {k: f"__right_{i}" for i, k in enumerate(keys)}
    right = right.select(*(F.col(c).alias(names.get(c, c)) for c in right.columns))
    condition = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()), F.lit(True))
    return left.join(right, condition, how).drop(*names.values())


def quantiles(rows: DataFrame, keys: Sequence[str], values: dict[str, Column], shares: Sequence[float], whole: int = WHOLE) -> DataFrame:
    """Of each group and value the quantiles, as ``(*keys, name_0, name_1, ...)``.

    Between two ranks a quantile is interpolated; nulls count as no values, NaN as
    greater than all others, and a group without values has no row (without keys: a
    row of nulls).
    """
    group, x = [*keys, "__name"], F.col("__x")
    every = F.explode(F.array(*(F.struct(F.lit(n).alias("__name"), v.cast("double").alias("__x")) for n, v in values.items())))
    listed = rows.select(*keys, every.alias("__v")).select(*keys, "__v.*").where("__x is not null")
    # The sketch knows no NaN; infinity stands for it.
    sized = F.nanvl(x, F.lit(float("inf")))
    cuts = [min(1.0, max(0.0, p + side * _MARGIN)) for p in shares for side in (-1, 1)]
    sketch = listed.groupBy(*group).agg(F.count("*").alias("__n"), F.percentile_approx(sized, cuts, _ACCURACY).alias("__cuts"))
    known = join_keys(listed, sketch, group)
    all_in = F.col("__n") <= whole
    kept = []
    for k, p in enumerate(shares):
        low, high = F.col("__cuts")[2 * k], F.col("__cuts")[2 * k + 1]
        # What lies below is one cell without a value; what lies above is not needed.
        below, above = ~all_in & (sized < low), ~all_in & (sized > high)
        kept.append(F.when(~above, F.struct(F.lit(k).alias("__k"), F.lit(float(p)).alias("__p"), F.when(~below, x).alias("__y"))))
    needed = known.select(*group, "__n", F.explode(F.filter(F.array(*kept), lambda c: c.isNotNull())).alias("__c")).select(*group, "__n", "__c.*")
    cells = needed.groupBy(*group, "__n", "__k", "__p", "__y").agg(F.count("*").alias("__rows"))
    upto = F.sum("__rows").over(Window.partitionBy(*group, "__k").orderBy(F.col("__y").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("__end", upto).withColumn("__at", (F.col("__n") - 1) * F.col("__p"))
    holds = lambda r: F.col("__y").isNotNull() & (r >= F.col("__end") - F.col("__rows")) & (r < F.col("__end"))
    floor, ceil = F.floor("__at"), F.ceil("__at")
    picked = cells.groupBy(*group, "__k").agg(F.max(F.when(holds(floor), F.col("__y"))).alias("__a"), F.max(F.when(holds(ceil), F.col("__y"))).alias("__b"), F.max("__at").alias("__at"))
    a, b = F.col("__a"), F.col("__b")
    value = F.when(floor == ceil, a).otherwise((ceil - F.col("__at")) * a + (F.col("__at") - floor) * b)
    picked = picked.withColumn("__value", F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("a rank lies outside its sketch"))).otherwise(value))
    named = [F.max(F.when((F.col("__name") == n) & (F.col("__k") == k), F.col("__value"))).alias(f"{n}_{k}") for n in values for k in range(len(shares))]
    return picked.groupBy(*keys).agg(*named)
