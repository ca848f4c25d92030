"""Mixture-controlled packing of documents into sequences of token ids.

Every source is a queue of its documents' ids, cut into quanta of QUANTUM ids. Deficit
round-robin serves the source that is furthest behind its target share: quantum j of a
source with target weight w is due at (j + 1/2) / w, and the sequence windows are filled
in the order of these times. A window of 1024 ids holds eight quanta; what a source lacks or has had
too much stays in its deficit, which is never more than a quantum, and carries over to
the next window. An empty queue leaves its share to the others in their proportions.
The weights default to the queues' lengths, so that all queues end together and every
window keeps the mixture of the whole.

The place of a quantum has a closed form - it is the number of ids that all sources
have had by its time - so no task replays the rounds: partitions need only where
their part of each queue begins, which is one running sum over (source, partition) totals.

Sequences hold 1024 ids; only the last one may be shorter. Rows: null text counts
as empty, an empty text is its end id alone. A null source is a queue of its own.
Repeated rows are packed once each. Extra columns are ignored; an empty table gives an
empty result.
"""

import base64
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, tidy

WINDOW, QUANTUM, END = 1024, 128, 0


class Encoder(dict):
    """Ids of a byte-level BPE vocabulary as little-endian 16-bit bytes.

    The pattern that cuts a text never crosses from a non-space to a space, so a text
    whose spaces are single is the chain of its words, each with the space before it; these are kept in a
    dictionary. Other texts are encoded whole, and texts that may hold a special token's string by
    the reference tokenizer itself.
    """

    most = 200_000

    def __init__(self, path=None):
        import public_tokenizers
        import tiktoken

        self.path = path or public_tokenizers.path("byte_bpe_50k.json")
        ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                       special_tokens={})
        self.whole = None

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        bare = word[1:]
        odd = not bare or bare[0].isspace() or bare[-1].isspace()
        value = self[word] = None if odd else self.of(word)
        return value

    def of(self, text):
        return array("H", self.coder.encode_ordinary(text)).tobytes()

    def ids(self, text):
        if "<|" in text:
            if self.whole is None:
                from tokenizers import Tokenizer
                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if not text:
            return b""
        first, *words = text.split(" ")
        if not first or first[-1].isspace():
            return self.of(text)
        parts = [self[" " + w] for w in words]
        if None in parts:
            return self.of(text)
        return self.of(first) + b"".join(parts)


QUEUED = "chunk long, name string, doc_id long, before long, n long, ids binary"


def _queue(path):
    def queue(batches):
        encoder, chunk, had = Encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [encoder.ids(t or "") + b"\0\0" for t in part.column(2).to_pylist()]
                names, before = part.column(1).to_pylist(), []
                for name, x in zip(names, ids, strict=True):
                    before.append(had.get(name, 0))
                    had[name] = before[-1] + len(x) // 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(ids), pa.int64()), part.column(1), part.column(0), pa.array(before, pa.int64()),
                     pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["chunk", "name", "doc_id", "before", "n", "ids"])

    return queue


def places(source, quantum, totals, weights):
    """First id position, in the whole stream, of quanta ``quantum`` of sources ``source`` (indices)."""
    due = lambda j, w: (j + 0.5) / w
    time = due(quantum, weights[source])
    out = np.zeros(len(quantum), np.int64)
    for s, (total, w) in enumerate(zip(totals, weights, strict=True)):
        # quanta of s that come before: guess from the inverse, then settle by the times themselves
        n = np.floor(time * w - 0.5).astype(np.int64) - 1
        for _ in range(4):
            t = due(n, w)
            n += (t < time) | ((t == time) & (s < source))
        n = np.where(s == source, quantum, np.maximum(n, 0))
        out += np.minimum(total, n * QUANTUM)
    return out


def _cut(names, totals, weights, window):
    index = {n: k for k, n in enumerate(names)}
    totals, weights = np.array(totals, np.int64), np.array(weights, np.float64)

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            begin, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            source = np.array([index[x] for x in batch.column(1).to_pylist()])
            first = begin // QUANTUM
            each = (begin + n - 1) // QUANTUM - first + 1
            doc = np.repeat(np.arange(len(n)), each)
            j = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
            a = np.maximum(begin[doc], j * QUANTUM)
            b = np.minimum(begin[doc] + n[doc], (j + 1) * QUANTUM)
            at = places(source[doc], j, totals, weights) + a - j * QUANTUM
            room = window - at % window
            over = np.flatnonzero(b - a > room)  # pieces that cross the end of a window
            doc2, a2, b2, at2 = doc[over], a[over] + room[over], b[over], at[over] + room[over]
            b = np.minimum(b, a + room)
            doc, a, b, at = (np.concatenate(x) for x in ((doc, doc2), (a, a2), (b, b2), (at, at2)))
            start, length = a - begin[doc], b - a
            ids = [np.frombuffer(x, "<u2").astype("<u4") for x in batch.column(4).to_pylist()]
            crc = [zlib.crc32(ids[d][s:s + m]) for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(start), pa.array(length),
                 pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(at // window), pa.array(at % window)],
                ["doc_id", "name", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return cut


def packed(docs, weights=None, path=None, window=WINDOW):
    """Pieces of every row of ``docs`` (doc_id, source, text) and their places in the sequences.

    ``weights`` maps a source to its target share; sources that it lacks (and all,
    where it is None) get shares by their number of ids.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("name")
    queued = stored(docs.select("doc_id", name, "text").mapInArrow(tidy(_queue(path)), QUEUED), "pack-ids")
    parts = queued.groupBy("name", "chunk").agg(F.sum("n").alias("part"))
    w = Window.partitionBy("name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("name").alias("b_name"), F.col("chunk").alias("b_chunk"),
                         F.coalesce(F.sum("part").over(w), F.lit(0)).alias("base"))
    found = queued.groupBy("name").agg(F.sum("n").alias("n")).orderBy("name").toArrow().to_pydict()
    shares = [(weights or {}).get(n[1:] if n else None, t) for n, t in zip(found["name"], found["n"], strict=True)]
    placed = queued.join(bases, (F.col("name") == F.col("b_name")) & (F.col("chunk") == F.col("b_chunk")))
    pieces = placed.select("doc_id", "name", (F.col("base") + F.col("before")).alias("begin"), "n", "ids").mapInArrow(
        tidy(_cut(found["name"], found["n"], shares, window)),
        "doc_id long, name string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.select("doc_id", F.when(F.col("name") != "", F.expr("substring(name, 2)")).alias("source"), "start", "length",
                         "ids_crc32", "doc_tokens", "sequence_id", "offset")
