"""Mix sources to target weights by systematic sampling, in built-in functions.

Targets: sources in code point order, null last, take the weights in turn and
share a budget of words; a source takes at most ``max_copies`` times its size
and what exceeds that is shared again by weight among the others.  The fixed
point of that resharing is a water level, found from prefix sums over the
sources ordered by the level at which each is full.

Sampling: every document of a source is expected ``target / size`` times.
With the documents in a fixed order, position p and one random offset u in
[0, 1), a document is taken once for each integer in (u + (p-1) r, u + p r].
Documents are ordered by size class, so the words taken come near the target
and not only the number of documents.

The positions need no task that holds a whole source: a source is cut into
cells of (size class, hash of the id), rows are numbered within cells, and a
prefix sum over the counts of cells gives each cell's offset.  A source has at
most 1024 size classes times 64 cells.

Defined cases: a null text has size 0; null sources are one source; a source
of size 0 has target 0; rows that repeat an id are rows of their own, in the
order of a hash of their texts; equal rows are interchangeable; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aircadence.workspace import Workspace

_SALTS = 64


def word_count(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _hash_number(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("bigint")


def targets(rows: DataFrame, weights: tuple[int, ...], share: float, max_copies: int) -> DataFrame:
    """One row for each source: ``(__key, source_size, target)``."""
    sources = rows.groupBy("__key", "__source").agg(F.sum("__size").alias("source_size"))
    in_order = Window.orderBy(F.col("__source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    weighed = weighed.withColumn("cap", (F.col("source_size") * max_copies).cast("double")).withColumn("full_at", F.col("cap") / F.col("w"))
    before = Window.orderBy("full_at", F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything).cast("double") * share
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", left / open_weight)
    # The first source, by level at which it is full, that the level does not fill.
    open_level = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "__source", "level"))
    first = F.min(open_level).over(everything)["level"]
    return levels.select("__key", "source_size", F.least(F.col("cap"), F.coalesce(first, F.lit(float("inf"))) * F.col("w")).alias("target"))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Add what sampling needs, under names with two underscores."""
    size = F.col("__size")
    bits = F.length(F.bin(size))
    top = F.when(bits >= 4, F.expr("shiftright(__size, length(bin(__size)) - 4)")).otherwise(F.expr("shiftleft(__size, 4 - length(bin(__size)))"))
    source = F.col(source_col).cast("string")
    return (
        docs.withColumn("__source", source)
        .withColumn("__key", F.coalesce(F.concat(F.lit("="), source), F.lit("-")))
        .withColumn("__id", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
        .withColumn("__size", word_count(text_col))
        .withColumn("__tie", F.xxhash64(text_col))
        .withColumn("__class", (bits * 16 + top).cast("int"))
        .withColumn("__salt", F.pmod(_hash_number(F.coalesce(F.col(id_col).cast("string"), F.col("__tie").cast("string")), 4), F.lit(_SALTS)).cast("int"))
    )


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, seed: int = 0, light: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies`` added.

    ``light`` may pass the id, source and text columns of the same rows from
    elsewhere, so that counting cells does not read the other columns.
    """
    cell = ["__key", "__class", "__salt"]
    rows = _rows(docs, id_col, text_col, source_col)
    counted = _rows(docs.select(id_col, text_col, source_col) if light is None else light, id_col, text_col, source_col)
    cells = counted.groupBy("__key", "__source", "__class", "__salt").agg(F.count("*").alias("n"), F.sum("__size").alias("__size"))
    cells = Workspace(docs.sparkSession, "mix").stage(cells, "cells")
    ahead = Window.partitionBy("__key").orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*cell, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__before"))
    offsets = offsets.join(targets(cells, weights, share, max_copies), "__key")
    numbered = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*cell).orderBy("__size", "__id", "__tie")))
    placed = numbered.join(offsets, cell)
    u = _hash_number(F.concat(F.lit(f"mix:{seed}:"), F.col("__key")), 12) / F.lit(float(1 << 48))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    position = F.col("__before") + F.col("__rank")
    copies = F.floor(u + position * rate) - F.floor(u + (position - 1) * rate)
    return placed.select(*docs.columns, F.col("__size").alias("size"), "source_size", "target", copies.cast("int").alias("copies"))


def mixture_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per row: ``(id_col, size, source_size, target, taken)``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    out = plan(rows, "id", "text", "source", **options)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it."""
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    light = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    out = plan(held.drop("text").withColumn("text", F.col("row")[text_col]), "id", "text", "source", light=light, **options)
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
