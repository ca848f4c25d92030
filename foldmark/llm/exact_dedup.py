"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every sender (a run of rows inside a task) fingerprints its normalised texts,
   sorts the fingerprints, cuts the list by owner (the leading bits) and codes
   the gaps of each piece with a Rice code.
2. An owner decodes the pieces sent to it and answers each sender with a bitmap
   over its piece: set where the fingerprint came from another sender, too.
   A fingerprint appears once per sender, however many copies it stands for.
3. Rows with a set bit, or with a copy inside their own sender, are suspects.
   Only their texts are shuffled: they are grouped by their bytes, which map-side
   aggregation reduces to one row per text and task, and the group's verdict goes
   back to the rows over the text's SHA-256.

Rows: null text counts as empty, and empty texts equal one another. A row without
``doc_id`` counts as smaller than any other. Of rows that agree in text and id
exactly one is kept. Extra columns are ignored; an empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import IdFilter, apart, lists, lowered, raw_texts, stored, tidy

ROWS_PER_SENDER = 250_000


def rice_parameter(values, width):
    """Bits of the remainder: the logarithm of the mean gap in ``width`` bits."""
    return max(0, width - int(len(values)).bit_length()) if len(values) else 0


def golomb(values, width):
    """Sorted distinct uint64 values below 2**width as Rice-coded gaps."""
    k = rice_parameter(values, width)
    gaps = np.diff(values, prepend=np.uint64(0))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def unpacked(blob, n, width):
    """Inverse of ``golomb`` for ``n`` values."""
    k = max(0, width - int(n).bit_length()) if n else 0
    low_bytes = (n * k + 7) // 8
    raw = np.frombuffer(blob, np.uint8)
    unary = np.unpackbits(raw[:len(raw) - low_bytes])
    high = np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1
    low = np.unpackbits(raw[len(raw) - low_bytes:])[:n * k].reshape(n, k).astype(np.uint64)
    gaps = (high.astype(np.uint64) << np.uint64(k)) | (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


SENT = ("sender long, owner int, n int, codes binary, place array<int>, copies array<boolean>, "
        "doc_id array<long>, sha array<binary>")


def _send(bits):
    def pieces(sender, marks, ids, shas):
        marks = np.array(marks, np.uint64)
        distinct, place, copies = np.unique(marks, return_inverse=True, return_counts=True)
        owner = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
        width = 64 - bits
        order = np.argsort(place, kind="stable")
        first_row = np.concatenate([[0], np.cumsum(copies)])
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        ids, shas = pa.array(ids, pa.int64()), pa.array(shas, pa.binary())
        out = []
        for a, b in zip(cuts, np.append(cuts[1:], len(distinct)), strict=True):
            part = distinct[a:b] & np.uint64((1 << width) - 1)
            rows = order[first_row[a]:first_row[b]]
            out.append((owner[a], b - a, golomb(part, width), place[rows] - a, copies[place[rows]] > 1, rows))
        flat = np.concatenate([x[5] for x in out])
        sizes = [len(x[5]) for x in out]
        return pa.RecordBatch.from_arrays([
            pa.array([sender] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()),
            pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary()),
            lists(np.concatenate([x[3] for x in out]).astype(np.int32), sizes, pa.int32()),
            lists(np.concatenate([x[4] for x in out]), sizes, pa.bool_()),
            lists(ids.take(pa.array(flat)), sizes, pa.int64()), lists(shas.take(pa.array(flat)), sizes, pa.binary()),
        ], ["sender", "owner", "n", "codes", "place", "copies", "doc_id", "sha"])

    def send(batches):
        sender = TaskContext.get().partitionId() << 20
        marks, ids, shas = [], [], []
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                text = text.lower()
                marks.append(xxhash.xxh3_64_intdigest(text))
                ids.append(i)
                shas.append(hashlib.sha256(text).digest())
            if len(marks) >= ROWS_PER_SENDER:
                yield pieces(sender, marks, ids, shas)
                sender, marks, ids, shas = sender + 1, [], [], []
        if marks:
            yield pieces(sender, marks, ids, shas)

    return send


def _answer(bits):
    def answer(table):
        width = 64 - bits
        sizes = table["n"].to_numpy()
        marks = np.concatenate([unpacked(c.as_py(), n, width) for c, n in zip(table["codes"], sizes, strict=True)])
        _, place, seen = np.unique(marks, return_inverse=True, return_counts=True)
        met = (seen > 1)[place]
        ends = np.cumsum(sizes)
        return pa.table({
            "sender": table["sender"], "owner": table["owner"],
            "bitmap": pa.array([np.packbits(met[e - n:e]).tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary()),
        })

    return answer


def _flag(batches):
    """One row per document from a sender's pieces and the bitmaps that came back."""
    for batch in batches:
        for sender, owner, place, copies, ids, shas, bitmap in zip(*(batch.column(k) for k in range(7)), strict=True):
            place = place.values.to_numpy()
            bits = np.unpackbits(np.frombuffer(bitmap.as_py(), np.uint8))[place].astype(bool)
            own = copies.values.to_numpy(zero_copy_only=False)
            row = (np.int64(owner.as_py()) << 32) + np.arange(len(place))
            yield pa.RecordBatch.from_arrays(
                [ids.values, shas.values, pa.array(bits | own), pa.array([sender.as_py()] * len(place), pa.int64()),
                 pa.array(row)], ["doc_id", "sha", "suspect", "sender", "row"])


def exact_groups(docs, owners=None):
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` needs ``doc_id`` and ``text``. Texts are equal when identical after
    lower-casing A-Z; the largest doc_id of a group stays. ``owners`` defaults to
    twice the session's shuffle partitions, rounded up to a power of two: an owner
    holds (distinct texts per sender, summed) / owners fingerprints of 8 bytes.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    owners = owners or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, (owners - 1).bit_length())
    sent = stored(docs.mapInArrow(tidy(_send(bits)), SENT), "exact-sent")
    bitmaps = (sent.select("sender", "owner", "n", "codes").groupBy("owner")
               .applyInArrow(_answer(bits), "sender long, owner int, bitmap binary"))
    rows = stored(sent.select("sender", "owner", "place", "copies", "doc_id", "sha")
                  .join(bitmaps, ["sender", "owner"])
                  .mapInArrow(tidy(_flag), "doc_id long, sha binary, suspect boolean, sender long, row long"), "exact-rows")
    suspects = rows.where("suspect")
    texts = IdFilter(suspects.select("doc_id")).rows(docs).select("doc_id", lowered(F.col("text")).alias("body"))
    groups = (texts.groupBy("body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .where("group_size > 1")
              .select(F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size"))
    # among rows that agree in text and id the last sender's last row stays
    winner = suspects.groupBy("sha", "doc_id").agg(F.max(F.struct("sender", "row")).alias("last"))
    winner = winner.join(groups, (winner["sha"] == groups["sha"]) & winner["doc_id"].eqNullSafe(groups["keep_id"]))
    verdict = winner.select(groups["sha"].alias("v_sha"), "keep_id", "group_size", "last")
    met = suspects.join(verdict, F.col("sha") == F.col("v_sha"), "left")
    alone = F.col("v_sha").isNull()
    out = met.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.struct("sender", "row") == F.col("last"))).alias("kept"), "sha")
    single = rows.where("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"),
                                              F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return out.unionByName(single).select("doc_id", "keep_id", "group_size", "kept",
                                          F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs):
    """``docs`` with one row of each group of equal texts, all columns kept, whatever their names."""
    docs, restored = apart(docs, "doc_id", "text")
    row = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_sha256")
    kept = exact_groups(docs).where("kept").select(row.alias("_row_of_text"))
    row = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2(lowered(F.col("text")), 256))
    return (docs.withColumn("_row_of_text", row).join(kept, "_row_of_text", "left_semi")
            .dropDuplicates(["_row_of_text"]).transform(restored))
