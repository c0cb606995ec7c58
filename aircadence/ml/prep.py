"""Preparation of feature tables: imputation, scaling, labels, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aircadence import schema as S
from aircadence.operators.quantiles import join_keys, quantiles


def feature_columns(rows: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are no identifiers, in table order."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [c for c, t in rows.dtypes if t.split("(")[0] in numeric and c not in S.IDENTIFIERS and c not in exclude]


def medians(rows: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median of each column over valid values, 0 for a column without any."""
    valid = {f"c{k}": F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for k, c in enumerate(columns)}
    one = quantiles(rows, [], valid, (0.5,)).first()
    return {c: one[f"c{k}_0"] or 0.0 for k, c in enumerate(columns)}


def impute(rows: DataFrame, columns: Sequence[str], values: dict[str, float] | None = None) -> DataFrame:
    """Null and NaN become the median (or the given values), then infinities 0."""
    values = medians(rows, columns) if values is None else values
    inf = float("inf")

    def fixed(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x), F.lit(float(values[c]))).when(x.isin(inf, -inf), F.lit(0.0)).otherwise(x)

    return rows.withColumns({c: fixed(c) for c in columns})


def scaling(rows: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a deviation of 0 counts as 1."""
    one = rows.agg(*(f(F.col(c).cast("double")).alias(f"{n}{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (one[f"m{c}"] or 0.0, one[f"s{c}"] or 1.0) for c in columns}


def scale(rows: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def encode_labels(rows: DataFrame, label: str) -> DataFrame:
    """Add ``label_index``: the place of the label among the sorted names."""
    names = rows.where(F.col(label).isNotNull()).select(label).distinct()
    index = names.withColumn("label_index", F.row_number().over(Window.orderBy(label)) - 1)
    return rows.join(index, label, "left")


#: Ranges of the shuffled order that are ranked apart.
_RANGES = 1 << 16


def _ranked(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Add ``__rank`` from 1 and ``__n``: place within the label in a seeded order of the key, and the label's rows.

    Rows are ranked within ranges of the order; a table of one row for each
    label and range carries the counts over, so no task holds a label.
    """
    # A multiplicative hash that any engine computes alike: (key + seed) * 2654435761 modulo 2^32, from halves,
    # so that no product overflows.
    word = F.pmod(F.pmod(F.col(key).cast("bigint"), F.lit(1 << 32)) + seed, F.lit(1 << 32))
    low, high = word.bitwiseAND(0xFFFF), F.shiftright(word, 16)
    mixed = F.pmod(low * F.lit(2654435761) + (high * F.lit(2654435761)).bitwiseAND(0xFFFF) * 65536, F.lit(1 << 32))
    placed = rows.withColumn("__mixed", mixed).withColumn("__range", F.floor(F.col("__mixed") / (4294967296 // _RANGES)))
    cell = [label, "__range"]
    of = Window.partitionBy(label)
    before = of.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*cell).agg(F.count("*").alias("__cell"))
    cells = cells.select(*cell, F.coalesce(F.sum("__cell").over(before), F.lit(0)).alias("__before"), F.sum("__cell").over(of).alias("__n"))
    ranked = placed.withColumn("__own", F.row_number().over(Window.partitionBy(*cell).orderBy("__mixed", key)))
    return join_keys(ranked, cells, cell).select(*rows.columns, (F.col("__before") + F.col("__own")).alias("__rank"), "__n")


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Add ``is_test``: a share of each label, by a seeded order of the key."""
    ranked = _ranked(rows, label, key, seed)
    return ranked.select(*rows.columns, (F.col("__rank") <= F.round(F.col("__n") * share)).alias("is_test"))


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` from 0: the labels dealt evenly in a seeded order."""
    ranked = _ranked(rows, label, key, seed)
    return ranked.select(*rows.columns, F.pmod(F.col("__rank") - 1, F.lit(folds)).cast("int").alias("fold"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Add ``weight``: rows / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    whole = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    counts = counts.crossJoin(F.broadcast(whole)).select(label, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return rows.join(counts, label)


def align(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A model's columns in its order after all others; missing ones are 0."""
    have = set(rows.columns)
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in columns))
