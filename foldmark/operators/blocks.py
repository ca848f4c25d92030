"""Exact all-pairs scoring of two vector tables in bounded blocks.

Each side is hashed into blocks of rows per key group (up to 32 768 rows, fewer where that keeps the cores busy). A query
block meets every reference block of its group exactly once (cogroup on the
block pair), the pair is scored by one matrix product, and only a reduced
result leaves the task: top k per row, best per label, a histogram, and so on.
A group holding a third of the table simply has more blocks, so no task ever
sees more than two blocks.

The block counts per group come from a count over the key columns alone; only
groups larger than one block are listed. A table without groups is cut into
enough blocks that its pairs occupy the cluster. Rows without a vector take no
part, and a score that is not finite is no score.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.pandas.types import to_arrow_type as arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .. import constants as C

ROWS_PER_BLOCK = 2048
ROWS_IN_MEMORY = 32_768  # 16 MB of 64 doubles: a side has no smaller blocks than tasks or this bound ask for
SCORE_DIGITS = 12  # scores equal to this many digits count as tied
_CHUNK_CELLS = 4_000_000  # score cells held at once inside a task


def _root(df):
    """Blocks a side whose pairs are as many as the cores."""
    return math.isqrt(max(0, df.sparkSession.sparkContext.defaultParallelism - 1)) + 1


def _hot_groups(queries, refs, keys, rows):
    """Block counts of the groups that exceed one block on either side.

    A row is repeated once per block of the other side. Without a size of its own a group is cut finer than memory asks for only
    until its pairs occupy the cores.
    """
    def tagged(df, q, r):
        return df.select(*keys, F.lit(q).alias("_q"), F.lit(r).alias("_r"))

    small, large, root = rows or ROWS_PER_BLOCK, rows or ROWS_IN_MEMORY, _root(queries)
    parts = lambda n, size: F.ceil(F.col(n) / size)
    blocks_of = lambda n: F.greatest(
        F.lit(1), parts(n, large), F.least(parts(n, small), F.lit(root) if rows is None else parts(n, small))).cast("int")
    return (tagged(queries, 1, 0).unionByName(tagged(refs, 0, 1))
            .groupBy(*keys).agg(F.sum("_q").alias("_q"), F.sum("_r").alias("_r"))
            .where((F.col("_q") > small) | (F.col("_r") > small))
            .select(*keys, blocks_of("_q").alias("_nq"), blocks_of("_r").alias("_nr")))


def _block_count(df, rows):
    """Number of blocks of a whole table, as a scalar subquery over its row count.

    At least the root of the cluster's cores, so that the block pairs are as many as the cores.
    """
    return df.agg(F.greatest(F.lit(_root(df)), F.ceil(F.count(F.lit(1)) / (rows or ROWS_IN_MEMORY))).cast("int").alias("n")).scalar()


def block_pairs(queries: DataFrame, refs: DataFrame, kernel, schema: StructType, *,
                keys=(), q_block="id", r_block="id", rows: int | None = ROWS_PER_BLOCK, once: bool = False) -> DataFrame:
    """Run ``kernel(query_table, ref_table) -> table`` on all block pairs of all key groups.

    ``q_block`` / ``r_block`` name the columns whose hash picks the block; rows
    equal in them stay together. ``rows`` None leaves the block size to memory and cores; a kernel whose result grows with both sides'
    rows needs a size. ``once``: both sides are the same table, and two blocks meet in one order only.
    """
    keys = list(keys)
    refs = refs.select(*[F.col(c).alias(c) for c in refs.columns])  # both sides may share a lineage
    for k in keys:
        if queries.schema[k].dataType != refs.schema[k].dataType:
            raise TypeError(f"key {k} differs in type between the two sides")
    if keys:
        hot = _hot_groups(queries, refs, keys, rows)
        queries, refs = queries.join(hot, keys, "left"), refs.join(hot, keys, "left")
        n_q, n_r = F.coalesce("_nq", F.lit(1)), F.coalesce("_nr", F.lit(1))
    else:
        n_q, n_r = _block_count(queries, rows), _block_count(refs, rows)

    def split(df, own, own_n, other, other_n, block_on):
        block = F.pmod(F.xxhash64(*([block_on] if isinstance(block_on, str) else block_on)), own_n).cast("int")
        first, last = F.lit(0), other_n - 1
        if once:  # the block of a query is not behind that of its reference
            first, last = (block, last) if own == "_qb" else (first, block)
        return df.select(
            *[c for c in df.columns if c not in ("_nq", "_nr")], block.alias(own),
            F.explode(F.sequence(first, last)).alias(other))

    by = keys + ["_qb", "_rb"]
    q = split(queries, "_qb", n_q, "_rb", n_r, q_block).groupBy(*by)
    r = split(refs, "_rb", n_r, "_qb", n_q, r_block).groupBy(*by)
    arrow = to_arrow_schema(schema)

    def score(qt, rt):
        if qt.num_rows == 0 or rt.num_rows == 0:
            return arrow.empty_table()
        return kernel(qt, rt).select(arrow.names).cast(arrow)

    return q.cogroup(r).applyInArrow(score, schema)


# ---- inside a task: Arrow tables and numpy ---------------------------------

def column_values(table, name):
    return table.column(name).to_numpy()


def matrix_of(table, name, eps=None):
    """Vector column as a float64 matrix, rows divided by (length + eps) if given."""
    col = table.column(name).combine_chunks()
    widths = np.unique(pc.list_value_length(col).to_numpy(zero_copy_only=False))
    if len(widths) > 1:
        raise ValueError(f"vectors of {name} differ in length: {widths[:5].tolist()}")
    m = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    if eps is not None:
        m = m / (np.linalg.norm(m, axis=1, keepdims=True) + eps)
    return m


def row_chunks(n_rows, n_cols):
    step = max(1, _CHUNK_CELLS // max(1, n_cols))
    for a in range(0, n_rows, step):
        yield a, min(n_rows, a + step)


def best_in_rows(scores, k):
    """Row and column numbers of the k best cells per row; ties go to the left column.

    Rounding keeps order, so only cells within a rounding step of the k-th
    score can tie with it; just those are rounded and sorted.
    """
    n = scores.shape[1]
    k = min(k, n)
    scores = np.where(np.isfinite(scores), scores, -np.inf)
    bound = np.partition(scores, n - k, axis=1)[:, n - k] - 2 * 10.0 ** -SCORE_DIGITS
    row, col = np.nonzero((scores >= bound[:, None]) & np.isfinite(scores))
    value = np.round(scores[row, col], SCORE_DIGITS)
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep], value[keep]


def hide_same(scores, q_ids, sorted_r_ids, fill=-np.inf):
    """Set the cell of each query's own id to ``fill``."""
    at = np.searchsorted(sorted_r_ids, q_ids)
    at_in = np.minimum(at, len(sorted_r_ids) - 1)
    hit = np.nonzero(sorted_r_ids[at_in] == q_ids)[0]
    scores[hit, at_in[hit]] = fill
    return scores


def sorted_by(table, name):
    return table.take(pa.array(np.argsort(column_values(table, name), kind="stable")))


def with_vector(df, vector):
    """Rows that have a vector."""
    return df.where(F.col(vector).isNotNull())


# ---- operators -------------------------------------------------------------

def _payload(df, drop, prefix=""):
    return [StructField(prefix + f.name, f.dataType, True) for f in df.schema if f.name not in drop]


def top_matches(queries: DataFrame, refs: DataFrame, k: int, *, vector="fingerprint",
                q_key=("id",), r_key="id", keys=(), exclude_self=False, metric="cosine",
                rows: int | None = None, eps: float = C.EPS) -> DataFrame:
    """Exact k best references per query row.

    Output: the query's columns, the reference's columns prefixed ``ref_``,
    ``score`` (cosine, or negated squared distance for ``metric='l2'``) and
    ``rank`` from 1. Ties go to the smaller reference key. ``keys`` restricts
    the comparison to rows equal in them.
    """
    keys, q_key = list(keys), list(q_key)
    schema = StructType(_payload(queries, [vector]) + _payload(refs, [vector] + keys, "ref_")
                        + [StructField("score", DoubleType())])
    q_names = [c for c in queries.columns if c != vector]
    r_names = [c for c in refs.columns if c not in [vector] + keys]

    def kernel(qt, rt):
        rt = sorted_by(rt, r_key)
        unit = eps if metric == "cosine" else None
        q, r = matrix_of(qt, vector, unit), matrix_of(rt, vector, unit)
        r_ids = column_values(rt, r_key)
        q_ids = column_values(qt, q_key[0])
        half = (r * r).sum(axis=1)
        rows_, cols_, vals_ = [], [], []
        for a, b in row_chunks(len(q), len(r)):
            s = q[a:b] @ r.T
            if metric == "l2":
                s = 2.0 * s - half - (q[a:b] * q[a:b]).sum(axis=1)[:, None]
            if exclude_self:
                s = hide_same(s, q_ids[a:b], r_ids)
            i, j, v = best_in_rows(s, k)
            rows_.append(i + a)
            cols_.append(j)
            vals_.append(v)
        i, j = pa.array(np.concatenate(rows_)), pa.array(np.concatenate(cols_))
        left, right = qt.select(q_names).take(i), rt.select(r_names).take(j)
        return pa.Table.from_arrays(
            left.columns + right.columns + [pa.array(np.concatenate(vals_))],
            names=q_names + ["ref_" + c for c in r_names] + ["score"])

    found = block_pairs(with_vector(queries, vector), with_vector(refs, vector), kernel, schema, keys=keys,
                        q_block=q_key, r_block=r_key, rows=rows)
    order = Window.partitionBy(*q_key).orderBy(F.desc("score"), F.asc("ref_" + r_key))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_per_label(queries: DataFrame, refs: DataFrame, label: str, *, vector="fingerprint",
                   q_key=("id",), r_key="id", keys=(), rows: int = ROWS_PER_BLOCK,
                   eps: float = C.EPS) -> DataFrame:
    """Best score of each query row against every label of the references.

    Output: query columns, the label, ``score`` and ``ref_key`` of its first
    best reference. A block emits one row per query and label it holds.
    """
    q_names = [c for c in queries.columns if c != vector]
    schema = StructType(_payload(queries, [vector])
                        + [StructField(label, refs.schema[label].dataType),
                           StructField("score", DoubleType()),
                           StructField("ref_key", refs.schema[r_key].dataType)])

    def kernel(qt, rt):
        rt = sorted_by(sorted_by(rt, r_key), label)
        q, r = matrix_of(qt, vector, eps), matrix_of(rt, vector, eps)
        values = column_values(rt, label)
        starts = np.concatenate(([0], np.nonzero(values[1:] != values[:-1])[0] + 1, [len(values)]))
        n_q = len(q)
        best = np.empty((n_q, len(starts) - 1))
        where = np.empty((n_q, len(starts) - 1), dtype=np.int64)
        for a, b in row_chunks(n_q, len(r)):
            s = np.round(q[a:b] @ r.T, SCORE_DIGITS)
            s = np.where(np.isfinite(s), s, -np.inf)
            for g, (lo, hi) in enumerate(zip(starts[:-1], starts[1:])):
                j = s[:, lo:hi].argmax(axis=1)
                best[a:b, g] = s[np.arange(b - a), lo + j]
                where[a:b, g] = lo + j
        n_l = len(starts) - 1
        real = np.isfinite(best.ravel())  # a label may hold no usable vector
        left = qt.select(q_names).take(pa.array(np.repeat(np.arange(n_q), n_l)[real]))
        at = pa.array(where.ravel()[real])
        return pa.Table.from_arrays(
            left.columns + [rt.column(label).take(at), pa.array(best.ravel()[real]), rt.column(r_key).take(at)],
            names=q_names + [label, "score", "ref_key"])

    # a label's references go to as few blocks as its size allows, so that a query row gets few rows per label
    refs = with_vector(refs, vector)
    sizes = refs.groupBy(label).agg(F.ceil(F.count(F.lit(1)) / rows).alias("_parts"))
    refs = refs.join(sizes, label).withColumn("_part", F.pmod(F.xxhash64(r_key), F.col("_parts"))).drop("_parts")
    found = block_pairs(with_vector(queries, vector), refs, kernel, schema, keys=keys, q_block=list(q_key),
                        r_block=[label, "_part"], rows=rows)
    first_best = F.min(F.struct((-F.col("score")).alias("neg"), F.col("ref_key"))).alias("_b")
    return (found.groupBy(*q_names, label).agg(first_best)
            .select(*q_names, label, (-F.col("_b.neg")).alias("score"), F.col("_b.ref_key").alias("ref_key")))


_TILE = 64, 4_096  # rows and columns of scores counted at once


def _codes(a, b):
    """Equal numbers for equal values of two columns; NaN is equal to nothing, None to None."""
    both = np.concatenate([a, b])
    if both.dtype == object:
        code = pc.dictionary_encode(pa.array(both, from_pandas=False), null_encoding="encode").indices.to_numpy()
    else:
        code = np.unique(both, return_inverse=True, equal_nan=False)[1]
    return code[:len(a)], code[len(a):]


def _fine_cells(edges, n=1 << 14):
    """(cell numbers of scores, bin per cell or -1 outside, whether an edge is too near to tell from the cell)."""
    width = (edges[-1] - edges[0]) / n
    low = edges[0] - 2 * width

    def cell_of(s):
        f = (s - low) / width
        return np.fmax(np.fmin(f, n + 5, out=f), 0, out=f).astype(np.int64)  # NaN goes to the last cell

    middle = low + (np.arange(n + 6) + 0.5) * width
    bin_of = np.searchsorted(edges, middle, "right") - 1
    bin_of[(middle < edges[0]) | (middle > edges[-1])] = -1
    unsure = np.zeros(n + 6, bool)
    for e in edges:
        unsure[cell_of(np.array([e - 1e-9, e, e + 1e-9]))] = True
    return cell_of, bin_of, unsure


def similarity_histogram(rows_df: DataFrame, label: str, edges, *, vector="fingerprint", key="id",
                         include_self=False, rows: int | None = ROWS_PER_BLOCK * 8, eps: float = 0.0) -> DataFrame:
    """Counts of all ordered pair scores between bin edges, within and across labels.

    Output: ``kind`` (intra/inter), ``bin`` from 1, ``n``. Values outside the
    edges are dropped and the last bin is closed. Blocks emit counts only.
    """
    from pyspark.sql.types import StringType
    schema = StructType([StructField("kind", StringType()), StructField("bin", IntegerType()),
                         StructField("n", LongType())])
    edges = np.asarray(edges, dtype=np.float64)

    cell_of, bin_of, unsure = _fine_cells(edges)

    def kernel(qt, rt):
        ql, rl = _codes(column_values(qt, label), column_values(rt, label))
        q_order, r_order = np.argsort(ql, kind="stable"), np.argsort(rl, kind="stable")
        ql, rl = ql[q_order], rl[r_order]
        q, r = matrix_of(qt, vector, eps)[q_order], matrix_of(rt, vector, eps)[r_order]
        q_ids, r_ids = column_values(qt, key)[q_order], column_values(rt, key)[r_order]
        by_id = np.argsort(r_ids, kind="stable")
        at = by_id[np.minimum(np.searchsorted(r_ids, q_ids, sorter=by_id), len(r_ids) - 1)]
        own = np.where(r_ids[at] == q_ids, at, -1) if not include_self else np.full(len(q_ids), -1)
        first, last = np.searchsorted(rl, ql, "left"), np.searchsorted(rl, ql, "right")
        cells, total = np.zeros((2, len(bin_of)), np.int64), np.zeros((2, len(edges) - 1), np.int64)  # intra, all
        for a in range(0, len(q), _TILE[0]):
            b = min(len(q), a + _TILE[0])
            runs = np.flatnonzero(np.append(True, ql[a + 1:b] != ql[a:b - 1]))
            for c in range(0, len(r), _TILE[1]):
                d = min(len(r), c + _TILE[1])
                s = q[a:b] @ r[c:d].T
                mine = np.flatnonzero((own[a:b] >= c) & (own[a:b] < d))
                s[mine, own[a:b][mine] - c] = -np.inf
                cell = cell_of(s)
                cells[1] += np.bincount(cell.ravel(), minlength=len(bin_of))
                part = [cell[i:j, max(first[a + i], c) - c:max(0, min(last[a + i], d) - c)].ravel()
                        for i, j in zip(runs, np.append(runs[1:], b - a), strict=True)]
                cells[0] += np.bincount(np.concatenate(part), minlength=len(bin_of))
                i, j = np.divmod(np.flatnonzero(unsure.take(cell)), d - c)
                exact = np.round(s[i, j], SCORE_DIGITS)
                total[0] += np.histogram(exact[ql[a + i] == rl[c + j]], edges)[0]
                total[1] += np.histogram(exact, edges)[0]
        sure = np.flatnonzero(~unsure & (bin_of >= 0))
        for k in (0, 1):
            np.add.at(total[k], bin_of[sure], cells[k][sure])
        total[1] -= total[0]
        n_bins = len(edges) - 1
        return pa.table({"kind": ["intra"] * n_bins + ["inter"] * n_bins,
                         "bin": np.tile(np.arange(1, n_bins + 1, dtype=np.int32), 2),
                         "n": total.ravel()})

    return (block_pairs(rows_df, rows_df, kernel, schema, q_block=key, r_block=key, rows=rows)
            .groupBy("kind", "bin").agg(F.sum("n").alias("n")))
