"""Lempel-Ziv phrase fingerprints: documents that compress alike have like fingerprints.

A text is parsed into LZ78 phrases: each phrase is the shortest run of code points that is not in the dictionary yet, and then
enters it. The phrase set is hashed to 32 bits and the SIZE smallest distinct hashes are the signature, written in hex. The likeness of two
signatures is the share of the SIZE smallest hashes of their union that both hold: an estimate of the
Jaccard similarity of the phrase sets, exact for sets of up to SIZE phrases together.

``compared`` also fingerprints each text after an edit that puts the beginning of the next document (by descending
doc_id, the first after the last) in the place of its second half. An edited text has the phrases of the
original up to the cut, so its parse goes on from there.

Scale: rows are dealt once by ranges of doc_id, found by approximate quantiles, and sorted inside a range; a task streams
over its rows and holds one text and its successor. The first rows of a range, one per range, are read again
by their ids and go along with the range before.

Rows: null text counts as empty; a text without phrases has the empty fingerprint, which is wholly like itself and
unlike any other. Rows without doc_id come last. Rows that share a doc_id are ordered by text. A single row is its own next. Repeated
rows have equal fingerprints. Texts of any length are parsed whole. Extra columns are ignored; an empty table gives an empty result.
"""

import bisect
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import mixed, tidy

SIZE = 64
PARSED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_BACK = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the hash's base and of its inverse, as far as the longest text of the task needs them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n):
        if len(self.up) < n:
            more = np.full(max(n, 2 * len(self.up)), _BASE, np.uint64)
            more[0] = 1
            back = np.full(len(more), _BACK, np.uint64)
            back[0] = 1
            self.up, self.down = np.cumprod(more), np.cumprod(back)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def coded(text):
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def parsed(codes, at, trie, ends):
    """Parse ``codes`` from ``at`` on: new phrases enter ``trie``, and where they end ``ends``.

    The trie is a dictionary (parent phrase, code point) -> number of the phrase, in order of entry; a phrase is a known one and
    a code point more.
    """
    node, count, known = 0, len(trie), trie.get
    for at, c in enumerate(codes[at:].tolist(), at + 1):  # noqa: B020
        key = node << 21 | c
        node = known(key)
        if node is None:
            count += 1
            trie[key] = count
            ends.append(at)
            node = 0
    return ends


def hashed(codes, ends, first=0):
    """32-bit hashes of the phrases from the ``first`` on, which lie end to end: differences of one running polynomial sum."""
    ends = np.array(ends, np.int64)
    starts = np.concatenate([[0], ends[:-1]])[first:]
    ends = ends[first:]
    up, down = _powers.upto(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    return (mixed((sums[ends] - sums[starts]) * down[starts]) >> np.uint64(32)).astype(np.uint32)


def smallest(hashes):
    """The SIZE smallest distinct hashes, ascending."""
    if len(hashes) > 4 * SIZE:
        low = np.unique(np.partition(hashes, 2 * SIZE)[:2 * SIZE])
        if len(low) >= SIZE:
            return low[:SIZE]
    return np.unique(hashes)[:SIZE]


def signature(phrases):
    """Signature of a set of phrases given as texts."""
    return smallest(np.array([hashed(coded(p), [len(p)])[0] for p in phrases], np.uint32))


def likeness(a, b):
    """Share of the smallest hashes of the union that both signatures hold; 1 for two empty ones."""
    both = np.union1d(a, b)[:SIZE]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True)).sum() / len(both))


def written_out(sig):
    return sig.astype(">u4").tobytes().hex()


class Document:
    """A text with its parse, the hashes of its phrases in order, and its signature."""

    def __init__(self, doc_id, text):
        self.id, self.text, self.trie, self.codes = doc_id, text, {}, coded(text)
        self.ends = parsed(self.codes, 0, self.trie, [])
        self.hashes = hashed(self.codes, self.ends)
        self.print = smallest(self.hashes)

    def edited(self, following):
        """(edited text, its signature): the second half replaced by the beginning of ``following``."""
        half = len(self.text) // 2
        cut = len(self.text) - half
        text = self.text[:cut] + following[:half]
        k = bisect.bisect_right(self.ends, cut)  # phrases that end before the cut stay
        codes, ends = coded(text), self.ends[:k]
        parsed(codes, ends[-1] if k else 0, dict(itertools.islice(self.trie.items(), k)), ends)
        return text, smallest(np.concatenate([self.hashes[:k], hashed(codes, ends, k)]))

    def row(self, following):
        text, sig = self.edited(following.text)
        return (self.id, len(self.text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
                written_out(self.print), written_out(sig), likeness(self.print, sig), likeness(self.print, following.print))


def _run(batches):
    """Rows in the order of their ranges, each range's last row being only the next of the one before."""
    before = before_range = None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, rows = batch.slice(at, 256), []
            for span, doc_id, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                now = Document(doc_id, text or "")
                if before is not None and before_range == span:
                    rows.append(before.row(now))
                before, before_range = now, span
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
NAMES = [c.split()[0] for c in PARSED.split(", ")]


def compared(docs, ranges=None):
    """One row per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    ``ranges`` defaults to the session's shuffle partitions.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * ranges)).alias("q")).first()["q"] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("long")
    def span(ids):
        known = ids.notna().to_numpy()
        values = ids.fillna(0).to_numpy().astype(np.int64)
        return ids.__class__(np.where(known, len(cuts) - np.searchsorted(cuts, values, side="right"), len(cuts) + 1))

    dealt = docs.withColumn("span", span("doc_id"))
    ends = dealt.groupBy("span").agg(F.max("doc_id").alias("top")).orderBy("span").collect()  # one row per range
    if not ends:
        return spark.createDataFrame([], PARSED)
    before = {e["span"]: ends[k - 1]["span"] for k, e in enumerate(ends)}
    tops = [e["top"] for e in ends]
    first = F.col("doc_id").isin([t for t in tops if t is not None])
    if None in tops:
        first = first | F.col("doc_id").isNull()
    heads = (dealt.where(F.coalesce(first, F.col("doc_id").isNull())).groupBy("span", "doc_id")
             .agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    to = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])
    rows = dealt.select("span", "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("extra")).unionByName(
        heads.select(to[F.col("span")].alias("span"), "doc_id", "text", F.lit(True).alias("extra")))
    order = ["span", "extra", F.col("doc_id").desc_nulls_last(), "text"]
    return (rows.repartitionById(ranges + 1, F.col("span").cast("int")).sortWithinPartitions(*order)
            .select("span", "doc_id", "text").mapInArrow(tidy(_run), PARSED))
