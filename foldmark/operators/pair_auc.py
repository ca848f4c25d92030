"""AUC of the cosine of every two rows of a group, without a row per pair.

A block pair is scored by matrix products. Its scores become whole numbers (``digits`` places) whose last bit tells the pairs of one
label, and what leaves the task are sorted runs, cut at borders sampled from the scores. One
task merges the runs of one range, so memory is bounded by the range and a score is never a row of its own. Borders only deal the
work: whatever they are, every pair is counted once.

The runs hold about as much as the pairs, so they are shuffled in passes over the ranges: a pass scores the block pairs again, keeps the
scores of its own ranges, and its shuffle files go when its counts are written. So disk is bounded by a pass, not by the pairs.
"""

from __future__ import annotations

import contextlib
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import vectors as V
from ..sources.scratch import written
from . import blocks

PAIRS_IN_RANGE = 2_000_000  # 8 bytes each before they are merged
PAIRS_IN_PASS = 2_000_000_000  # scores shuffled at once, 6 to 7 bytes each on disk
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SAMPLE = 100_000  # scores that the borders are taken from
_RUNS = StructType([StructField("dims", IntegerType()), StructField("range", IntegerType()),
                    StructField("code", ArrayType(LongType())), StructField("n", ArrayType(LongType()))])
_PARTS = "dims int, range int, p double, q double, won double"


def _counted(codes, n):
    """Distinct codes, ascending, with the sums of their numbers."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def _won(code, n):
    """(pairs of one label, other pairs, wins of the former) of sorted codes that occur ``n`` times."""
    score = code >> 1
    start = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    p = np.add.reduceat(n * (code & 1), start).astype(np.float64)
    q = np.add.reduceat(n * (1 - (code & 1)), start).astype(np.float64)
    below = np.cumsum(q) - q
    return p.sum(), q.sum(), (p * (below + q / 2)).sum()


@contextlib.contextmanager
def _shuffle_files_go(spark):
    """Shuffle files go with the write that made them, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _passes(dims, cuts, ranges):
    """The ranges of all dimensions in passes of ``ranges``: per pass {dimension: (first range, last range)}."""
    every = [(d, k) for d in dims for k in range(len(cuts[d]) + 1)]
    for at in range(0, len(every), ranges):
        part = every[at:at + ranges]
        yield {d: (min(k for e, k in part if e == d), max(k for e, k in part if e == d)) for d in dict(part)}


def group_auc(rows: DataFrame, keys, dims=(0,), *, axes=None, mean=None, label: str = "label", key: str = "id",
              vector: str = "fingerprint", digits: int = blocks.SCORE_DIGITS, eps: float = C.EPS,
              block_rows: int | None = None, range_pairs: int = PAIRS_IN_RANGE, pass_pairs: int = PAIRS_IN_PASS) -> DataFrame:
    """AUC of the cosine against sameness of label over all pairs of rows equal in ``keys``: one row per entry of ``dims``.

    With ``axes`` and ``mean`` vectors are centred and brought to their first ``dims`` axes; 0 takes them as they are. Scores equal to
    ``digits`` places (at most 12) are ties and count half. Rows without a label, key or usable vector take no part; the AUC is null where
    pairs of one kind are missing.
    """
    keys, dims = list(keys), list(dims)
    scale = 10.0 ** digits
    few = 2 * scale <= 4_000_000  # so few numbers that larger blocks save runs
    size = block_rows or (8192 if few else blocks.ROWS_PER_BLOCK)
    use = V.usable(F.col(vector))
    for c in (*keys, label, key):
        use = use & F.col(c).isNotNull()
    side = rows.where(use).select(*keys, key, label, vector)
    parts = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def reduced(table, d):
        m = blocks.matrix_of(table, vector)
        if d:
            m = (m - mean) @ axes[:d].T
        return m / (np.linalg.norm(m, axis=1, keepdims=True) + eps)

    def ids_of(qt, rt):
        """Ids of both sides, and whether they are one block, where a pair would be met twice and a row meets itself."""
        q_ids, r_ids = blocks.column_values(qt, key), blocks.column_values(rt, key)
        return q_ids, r_ids, q_ids[0] in r_ids

    def sample(share):
        schema = StructType([StructField("dims", IntegerType()), StructField("score", DoubleType())])

        def kernel(qt, rt):
            q_ids, r_ids, own = ids_of(qt, rt)
            rng = np.random.default_rng([len(q_ids), len(r_ids)])
            at = rng.integers(0, len(q_ids) * len(r_ids), rng.poisson(share * len(q_ids) * len(r_ids)))
            i, j = at // len(r_ids), at % len(r_ids)
            if own:
                i, j = i[q_ids[i] < r_ids[j]], j[q_ids[i] < r_ids[j]]
            score = [np.einsum("ij,ij->i", reduced(qt, d)[i], reduced(rt, d)[j]) for d in dims]
            return pa.table({"dims": np.repeat(np.array(dims, np.int32), len(i)), "score": np.concatenate(score)})

        return blocks.block_pairs(side, side, kernel, schema, keys=keys, q_block=key, r_block=key, rows=size, once=True)

    sizes = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    ranges, cuts = int(pairs // range_pairs) + 1, {d: np.zeros(0, np.int64) for d in dims}
    if ranges > 1:
        at = [k / ranges for k in range(1, ranges)]
        got = sample(min(1.0, _SAMPLE / pairs)).groupBy("dims").agg(F.percentile_approx("score", at, 10_000).alias("cuts"))
        cuts |= {r["dims"]: np.unique(np.rint(np.array(r["cuts"]) * scale).astype(np.int64)) * 2 for r in got.collect()}

    def counts_of(spans):
        """Counts of the ranges of one pass: per dimension those from the first to the last of ``spans``."""
        def kernel(qt, rt):
            q_ids, r_ids, own = ids_of(qt, rt)
            _, kind = np.unique(np.concatenate([blocks.column_values(qt, label), blocks.column_values(rt, label)]), return_inverse=True)
            ql, rl = kind[:len(q_ids)], kind[len(q_ids):]
            out = {"dims": [], "range": [], "code": [], "n": []}
            for d, (low, high) in spans.items():
                q, r, borders = reduced(qt, d), reduced(rt, d), np.concatenate([[-np.inf], cuts[d], [np.inf]])
                held = []
                for a, b in blocks.row_chunks(len(q), len(r)):
                    number = np.rint((q[a:b] @ r.T) * scale)
                    keep = (number >= borders[low] / 2) & (number < borders[high + 1] / 2)
                    if own:
                        keep &= q_ids[a:b, None] < r_ids
                    code = np.sort(number[keep].astype(np.int64) * 2 + (ql[a:b, None] == rl)[keep])
                    if few:  # equal ones are counted before they leave the task
                        code, n = _counted(*(np.concatenate(x) for x in zip(*held, (code, np.ones_like(code)), strict=True)))
                        held = [(code, n)]
                    else:
                        held.append((code, None))
                for code, n in held:
                    bounds = np.concatenate([[0], np.searchsorted(code, cuts[d][low:high]), [len(code)]])
                    for k in np.flatnonzero(np.diff(bounds)):
                        out["dims"].append(d)
                        out["range"].append(low + k)
                        out["code"].append(code[bounds[k]:bounds[k + 1]])
                        out["n"].append(n[bounds[k]:bounds[k + 1]] if few else None)
            return pa.table({"dims": pa.array(out["dims"], pa.int32()), "range": pa.array(out["range"], pa.int32()),
                             "code": pa.array(out["code"], pa.list_(pa.int64())), "n": pa.array(out["n"], pa.list_(pa.int64()))})

        runs = blocks.block_pairs(side, side, kernel, _RUNS, keys=keys, q_block=key, r_block=key, rows=size, once=True)
        return runs.repartition(max(parts, 1), "dims", "range").groupBy("dims", "range").applyInArrow(merged, _PARTS)

    def merged(table):
        code = table.column("code").combine_chunks().flatten().to_numpy()
        if few:
            code, n = _counted(code, table.column("n").combine_chunks().flatten().to_numpy())
        else:
            code, n = np.sort(code), np.ones_like(code)
        p, q, won = _won(code, n)
        return pa.table({"dims": table.column("dims")[:1], "range": table.column("range")[:1], "p": [p], "q": [q], "won": [won]})

    with _shuffle_files_go(side.sparkSession):
        done = [written(counts_of(spans), "pair-ranges") for spans in _passes(dims, cuts, max(1, pass_pairs // range_pairs))]
    done = functools.reduce(DataFrame.unionByName, done)
    before = Window.partitionBy("dims").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    total = (done.withColumn("below", F.coalesce(F.sum("q").over(before), F.lit(0.0))).groupBy("dims")
             .agg((F.sum(F.col("won") + F.col("p") * F.col("below")) / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0))).alias("auc")))
    wanted = side.sparkSession.createDataFrame([(d,) for d in dims], "dims int")
    return wanted.join(F.broadcast(total), "dims", "left")
