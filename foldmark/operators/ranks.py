"""Row numbers and ranks in a total order without sorting a table, or a group, in one task.

Rows are dealt by sampled range borders and sorted inside a range; the places are written once. Counts per
(range, group) turn into offsets, so a group that holds most of the table is spread over many ranges. The
only window without a group runs over one row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

_BEFORE = (Window.unboundedPreceding, -1)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use."""
    used = {c.lower() for c in df.columns}
    while stem.lower() in used:
        stem += "_"
    return stem


def _offsets(counts: DataFrame, groups, part: str, size: str) -> tuple:
    """(rows of the same group in earlier ranges, rows of the group) for counts per (range, group)."""
    own = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum(size).over(own.orderBy(part).rowsBetween(*_BEFORE)), F.lit(0))
    return before, F.sum(size).over(own)


def _same(left: DataFrame, right: DataFrame, names) -> F.Column:
    """Null-safe equality of columns that both sides have."""
    met = F.lit(True)
    for c in names:
        met = met & left[c].eqNullSafe(right[c])
    return met


def numbered(df: DataFrame, order, groups=(), name: str = "row", total: str | None = None) -> DataFrame:
    """``df`` with its rows numbered from 0 in ``order`` within ``groups``.

    ``groups`` are column names, null counts as a value of its own. ``order`` holds names or sort expressions
    over the columns; rows that agree in all of it are numbered in any order, so end it with a key
    where that matters. ``total`` adds the group's number of rows.
    """
    groups = list(groups)
    at, part, start, size, skip = (free_name(df, s) for s in ("_at", "_part", "_start", "_size", "_skip"))
    keys = [F.col(g).asc_nulls_first() for g in groups]
    keys += [F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order]
    placed = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                     .withColumn(at, F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn(part, F.shiftright(at, 33))
    counts = placed.groupBy(part, *groups).agg(F.min(at).alias(start), F.count(F.lit(1)).alias(size))
    before, whole = _offsets(counts, groups, part, size)
    offsets = counts.select(part, *groups, (F.col(start) - before).alias(skip), whole.alias(size)).alias("o")
    placed = placed.alias("p")
    out = placed.join(offsets, _same(placed, offsets, [part, *groups]))
    return out.select(*[placed[c] for c in df.columns], (placed[at] - F.col(f"o.{skip}")).alias(name),
                      *([F.col(f"o.{size}").alias(total)] if total else []))


def ranked(df: DataFrame, by, name: str = "rank") -> DataFrame:
    """``df`` with the midrank (1 = lowest, ties share the mean of their places) of ``by`` over the whole table.

    Equal values are counted before they are placed, so a value that fills many rows is one row, and ties on a border of
    two ranges cannot occur. Rows whose ``by`` is null get a null rank.
    """
    size, before = free_name(df, "_size"), free_name(df, "_before")
    counts = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias(size))
    ranks = running(counts, by, size, before).select(
        by, (F.col(before) + (F.col(size) + 1) / 2.0).alias(name))
    return df.join(ranks, by, "left").select(*df.columns, name)


def running(counts: DataFrame, by: str, size: str, name: str) -> DataFrame:
    """``counts`` with the sum of ``size`` over all rows of smaller ``by`` (distinct values)."""
    part, inside = free_name(counts, "_part"), free_name(counts, "_inside")
    skip = free_name(counts, "_skip")
    placed = written(counts.repartitionByRange(by).withColumn(part, F.spark_partition_id()), "running")
    sums = placed.groupBy(part).agg(F.sum(size).alias(skip))
    earlier = F.coalesce(F.sum(skip).over(Window.orderBy(part).rowsBetween(*_BEFORE)), F.lit(0))
    offsets = sums.select(part, earlier.alias(skip))
    own = F.sum(size).over(Window.partitionBy(part).orderBy(by).rowsBetween(*_BEFORE))
    return (placed.withColumn(inside, F.coalesce(own, F.lit(0))).join(offsets, part)
            .select(*counts.columns, (F.col(inside) + F.col(skip)).alias(name)))
