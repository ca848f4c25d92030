"""Full rankings of labelled vectors by a sweep: query blocks hold still, all references stream past.

A row goes to its own query block and, as a reference, to every block. A task spools the references it gets to a file of its own in
order of label and key, so a row is shuffled once a block, a row's positives are one slice of the file, and memory holds no table.
Queries are then taken in chunks bounded by rows and by positives held (``HITS``); batches of the file pass each chunk. A score becomes a
whole number of 12 digits; one sort of a batch's numbers together with a query's sorted positives tells how many references
stand before each positive, so neither a negative nor a list of positives is ever shuffled, and a step costs no search per reference.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import blocks

ROWS, HITS = 32_768, 8_000_000  # query rows of a full block, positives (8 byte number, two 4 byte places) of a full chunk
PLAIN = 1e-300  # plain L2 normalisation that leaves zero vectors at zero
QUERY, REFERENCE = 0, 1
_SCALE = 10.0 ** blocks.SCORE_DIGITS
_BATCH_CELLS = 1 << 23  # vector cells of a batch of references
_BATCH_ROWS = 1 << 17  # an id's place in a batch, doubled, needs _SHIFT bits
_SHIFT = 19  # a number of 12 digits, its sign and the place fill 61 bits
_CHUNK_ROWS, _PRODUCT_ROWS, _PRODUCT_CELLS = 256, 32, 4_000_000
_LAST = np.iinfo(np.int64).max


def _dealt(side: DataFrame, label: str, key: str, rows: int) -> DataFrame:
    """Copies of every row per block and kind, each block whole in one partition."""
    session = side.sparkSession
    parts = max(1, min(int(session.conf.get("spark.sql.shuffle.partitions")), 2 * session.sparkContext.defaultParallelism))
    n = side.agg(F.greatest(F.lit(parts), F.ceil(F.count(F.lit(1)) / rows)).cast("long").alias("n")).scalar()
    own = F.col("to") < 0  # one copy as a query, one a block as a reference
    dealt = side.select(F.explode(F.sequence(F.lit(-1).cast("long"), n - 1)).alias("to"), n.alias("n"),
                        F.col(key).alias("id"), F.col(label).alias("label"), "vector")
    dealt = dealt.select(F.when(own, F.pmod(F.xxhash64("id"), F.col("n"))).otherwise(F.col("to")).alias("block"),
                         F.when(own, QUERY).otherwise(REFERENCE).alias("kind"), "id", "label", "vector")
    return dealt.repartitionById(parts, (F.col("block") % parts).cast("int"))


def _units(vectors):
    """Rows of length one; zero rows stay, and rows too short for a sum of squares are stretched first."""
    m = blocks.matrix_of(pa.table({"v": vectors}), "v")
    length = np.linalg.norm(m, axis=1, keepdims=True)
    if (short := np.flatnonzero(length[:, 0] < 1e-140)).size:
        m[short] /= np.maximum(np.abs(m[short]).max(axis=1, keepdims=True), 5e-324)
        length[short] = np.linalg.norm(m[short], axis=1, keepdims=True)
    return m / (length + PLAIN)


class _Block:
    """Queries in memory, references in two files that end with the block."""

    def __init__(self, top, hits):
        self.top, self.hits = top, hits
        self.parts, self.labels = [], []
        self.files, self.runs, self.n = None, [], 0

    def add(self, kind, ids, labels, vectors):
        if kind == QUERY:
            self.parts.append((ids, vectors))
            self.labels.extend(labels)
        elif self.parts:  # a block without queries keeps no references
            if self.files is None:
                self.files, self.width = (tempfile.TemporaryFile(), tempfile.TemporaryFile()), vectors.shape[1]
            for label, a, b in _runs(labels):
                if self.runs and self.runs[-1][0] == label:
                    self.runs[-1][2] = self.n + b
                else:
                    self.runs.append([label, self.n + a, self.n + b])
            self.n += len(ids)
            ids.astype(np.int64).tofile(self.files[0])
            vectors.tofile(self.files[1])

    def results(self, include_self):
        """(ids, labels, average precision, nearest rows as flat arrays with their number per row) by chunks."""
        if not self.parts:
            return
        ids, vectors = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        for f in self.files:
            f.flush()
        self.ids = np.memmap(self.files[0], np.int64, "r", shape=(self.n,))
        self.vectors = np.memmap(self.files[1], np.float64, "r", shape=(self.n, self.width))
        slices = {label: (a, b) for label, a, b in self.runs}
        a = 0
        while a < len(ids):
            b, held = a, 0
            while b < len(ids) and b - a < _CHUNK_ROWS and (b == a or held + np.subtract(*slices[self.labels[b]][::-1]) <= self.hits):
                held += np.subtract(*slices[self.labels[b]][::-1])
                b += 1
            yield self._chunk(ids[a:b], self.labels[a:b], vectors[a:b], slices, include_self)
            a = b
        for f in self.files:
            f.close()

    def _chunk(self, ids, labels, q, slices, include_self):
        runs = [(a, b, *slices[label]) for label, a, b in _runs(labels)]
        numbers, order = [], []  # of a row's positives, best first, equal ones by id; their places in the label's slice
        for a, b, lo, hi in runs:
            own = np.searchsorted(self.ids[lo:hi], ids[a:b])
            some = max(1, min(_PRODUCT_ROWS, _PRODUCT_CELLS // (hi - lo)))
            for k in range(a, b):
                if (k - a) % some == 0:
                    s = q[k:min(b, k + some)] @ self.vectors[lo:hi].T
                number, place = _sorted_numbers(_numbers(s[(k - a) % some]), own[k - a])
                numbers.append(number << _SHIFT)
                order.append(place.astype(np.int32))
        before = [np.zeros(len(x), np.int32 if self.n < 1 << 31 else np.int64) for x in numbers]
        best, bound = [], np.full(len(ids), np.inf)
        step = max(1, min(_BATCH_ROWS, _BATCH_CELLS // self.width))
        most = max(len(x) for x in numbers)
        work, flat = np.empty(step + most, np.int64), np.empty(step)
        for lo in range(0, self.n, step):
            batch, r = np.asarray(self.ids[lo:lo + step]), self.vectors[lo:lo + step]
            n = len(batch)
            by_id = np.argsort(batch, kind="stable")
            there, low = batch[by_id], np.empty(n, np.int64)
            low[by_id] = 2 * np.arange(n) + 1
            for a, b, p, e in runs:
                place = 2 * np.searchsorted(there, self.ids[p:e])
                from_, to = max(p, lo), min(e, lo + n)  # the part of the label's slice in this batch
                for c in range(a, b, _PRODUCT_ROWS):
                    scores = q[c:min(b, c + _PRODUCT_ROWS)] @ r.T
                    for k in range(c, min(b, c + _PRODUCT_ROWS)):
                        number = np.multiply(scores[k - c], -_SCALE, out=flat[:n])
                        np.rint(number, out=number)
                        if self.top:
                            best.append(self._candidates(k, number, lo, batch, bound))
                        line = work[:n + len(order[k])]
                        line[:n] = number
                        if from_ < to:
                            self._agree(line, numbers[k] >> _SHIFT, order[k], p, e, from_, to, lo)
                        line[:n] <<= _SHIFT
                        line[:n] += low
                        if from_ < to:  # a row is not ranked against itself
                            at = np.searchsorted(self.ids[from_:to], ids[k]) + from_
                            if at < to and self.ids[at] == ids[k]:
                                line[at - lo] = _LAST
                        np.add(numbers[k], place[order[k]], out=line[n:])
                        line.sort()
                        before[k] += np.flatnonzero((line & 1) == 0) - np.arange(len(order[k]))
            if self.top:
                best, bound = self._shorten(best, bound)
        ap = np.full(len(ids), np.nan)
        for k, ahead in enumerate(before):
            hits = len(ahead)
            found, total = (np.arange(1, hits + 1) / (ahead + 1.0)).sum(), hits
            if include_self:
                found, total = found + (hits + 1) / self.n, hits + 1
            if total:
                ap[k] = found / total
        near = None
        if self.top:
            row, number, key, at = best[0]
            starts = np.array([run[1] for run in self.runs])
            near = row, key, -number / _SCALE, [self.runs[j][0] for j in np.searchsorted(starts, at, "right") - 1]
        return ids, labels, ap, near

    @staticmethod
    def _agree(line, numbers, order, p, e, from_, to, lo):
        """References that are positives get the numbers they have as positives, whatever product made them."""
        whole = np.full(e - p, _LAST >> _SHIFT)  # the row itself is set apart later
        whole[order] = numbers
        line[from_ - lo:to - lo] = whole[from_ - p:to - p]

    def _candidates(self, k, number, lo, batch, bound):
        """References of a batch that may be among the first ``top`` of a row: (row, number, id, place in the file)."""
        limit = bound[k]
        if limit == np.inf and len(number) > self.top:
            some = number[:max(self.top, 2048)]
            limit = np.partition(some, self.top - 1)[self.top - 1]
        at = np.flatnonzero(number <= limit)
        return np.full(len(at), k), number[at], batch[at], at + lo

    def _shorten(self, best, bound):
        row, number, key, at = (np.concatenate([x[j] for x in best]) for j in range(4))
        order = np.lexsort((key, number, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        full = place == self.top - 1
        bound[row[full]] = number[order][full]
        keep = place < self.top
        order = order[keep]
        return [(row[keep], number[order], key[order], at[order])], bound


def _numbers(scores):
    return np.rint(scores * -_SCALE).astype(np.int64)


def _sorted_numbers(numbers, own):
    """Numbers ascending, equal ones by place, without the one at ``own``; and their places."""
    bits = max(1, int(len(numbers) - 1).bit_length())
    if bits <= 62 - 41:
        both = (numbers << bits) | np.arange(len(numbers))
        both[own] = _LAST
        both.sort()
        return both[:-1] >> bits, both[:-1] & ((1 << bits) - 1)
    order = np.argsort(numbers, kind="stable")
    order = order[order != own]
    return numbers[order], order


def _runs(labels):
    """(value, start, end) of each run of equal labels."""
    out, a = [], 0
    for k in range(1, len(labels) + 1):
        if k == len(labels) or labels[k] != labels[a]:
            out.append((labels[a], a, k))
            a = k
    return out


def ranking(rows: DataFrame, label: str = "label", key: str = "id", vector: str = "fingerprint", *, include_self: bool = True,
            top: int = 0, block_rows: int = ROWS, block_hits: int = HITS) -> DataFrame:
    """Average precision of every row over its full ranking, and with ``top`` its nearest rows.

    Output: key, label, ``ap`` (null without a positive) and, with ``top``, ``near``: (ref_label, ref_key, score), best first, the row
    itself included. Ties go to the smaller key. With ``include_self`` a row is ranked last and counts as a positive. ``key`` must be
    a unique bigint. Rows without a usable vector take no part.
    """
    side = rows.where(V.usable(F.col(vector))).select(key, label, F.col(vector).alias("vector"))
    kind = rows.schema[label].dataType
    dealt = _dealt(side, label, key, block_rows)
    schema = f"`{key}` bigint, `{label}` {kind.simpleString()}, ap double"
    if top:
        schema += f", near array<struct<ref_label: {kind.simpleString()}, ref_key: bigint, score: double>>"

    def emitted(block):
        for ids, labels, ap, near in block.results(include_self):
            columns = [pa.array(ids), pa.array(labels, arrow_label), pa.array(ap, mask=np.isnan(ap))]
            if top:
                count = np.bincount(near[0], minlength=len(ids))
                cells = pa.StructArray.from_arrays(
                    [pa.array(near[3], arrow_label), pa.array(near[1], pa.int64()), pa.array(near[2], pa.float64())],
                    ["ref_label", "ref_key", "score"])
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), cells))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, label, "ap"] + ["near"] * bool(top)
    arrow_label = blocks.arrow_type(kind)

    def sweep(batches):
        now, block = None, None
        for batch in batches:
            at = batch.column(0).to_numpy()
            kinds, ids = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            labels = batch.column(3).to_pylist()
            vectors = _units(batch.column(4))
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(at)), strict=True):
                if at[a] != now:
                    if block is not None:
                        yield from emitted(block)
                    now, block = at[a], _Block(top, block_hits)
                block.add(kinds[a], ids[a:b], labels[a:b], vectors[a:b])
        if block is not None:
            yield from emitted(block)

    return dealt.sortWithinPartitions("block", "kind", "label", "id").mapInArrow(sweep, schema)
