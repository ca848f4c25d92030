"""Interval joins as bucketed equi joins, and overlap counts from a grid.

A plain range predicate would become a nested-loop join. Here both sides are
expanded over fixed buckets, joined on (keys, bucket), and a pair is kept only
in the first bucket the two share, so it appears once. The interval side is
salted: one bucket holding a third of all intervals is spread over ``salt``
tasks, while the window side, small by comparison, is repeated per salt.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 12_800_000
SALT = 8


def _cell(position, width):
    return F.floor(position / F.lit(width)).cast("long")


def _expanded(df, start, last, width, first_name):
    first = _cell(F.col(start), width)
    return (df.withColumn(first_name, first)
            .withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, _cell(last, width))))))


def overlap_join(windows: DataFrame, intervals: DataFrame, keys, *, bucket: int = BUCKET, salt: int = SALT,
                 win=("win_start", "win_end"), iv=("start_bp", "end_bp")) -> DataFrame:
    """All (window, interval) pairs with start < win_end and end > win_start, per key."""
    ws, we = win
    s, e = iv
    left = _expanded(windows, ws, F.col(we) - 1, bucket, "_w0")
    right = _expanded(intervals, s, F.col(e) - 1, bucket, "_i0")
    on = list(keys) + ["_cell"]
    if salt > 1:
        left = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        right = right.withColumn("_salt", F.pmod(F.xxhash64(s, e), F.lit(salt)).cast("int"))
        on.append("_salt")
    return (left.join(right, on)
            .where((F.col(s) < F.col(we)) & (F.col(e) > F.col(ws)) & (F.col("_cell") == F.greatest("_w0", "_i0")))
            .drop("_cell", "_salt", "_w0", "_i0"))


def overlap_counts(windows: DataFrame, intervals: DataFrame, keys, category: str, *, grid: int = BUCKET,
                   bucket: int = BUCKET) -> DataFrame:
    """Overlapping intervals per (window, category), non-zero counts only.

    Windows whose edges lie on the grid need only the grid cells of an
    interval's ends, so intervals are first counted per (keys, category, first
    cell, last cell): a few rows per key however many intervals there are.
    Other windows go through the row-level join.
    """
    on_grid = (F.pmod("win_start", F.lit(grid)) == 0) & (F.pmod("win_end", F.lit(grid)) == 0)
    keys = list(keys)
    compact = (intervals.groupBy(*keys, category, _cell(F.col("start_bp"), grid).alias("_c0"),
                                 _cell(F.col("end_bp") - 1, grid).alias("_c1"))
               .agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_cell", F.explode(F.sequence("_c0", F.greatest("_c0", "_c1")))))
    cells = _expanded(windows.where(on_grid), "win_start", F.col("win_end") - 1, grid, "_w0")
    met = (cells.join(compact, keys + ["_cell"])
           .where((F.col("_c0") * grid < F.col("win_end")) & (F.col("_c1") >= F.col("_w0"))
                  & (F.col("_cell") == F.greatest("_w0", "_c0"))))
    by = keys + ["win_start", "win_end", category]
    fast = met.groupBy(*by).agg(F.sum("_n").alias("n"))
    slow = (overlap_join(windows.where(~on_grid), intervals, keys, bucket=bucket)
            .groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    return fast.unionByName(slow)
