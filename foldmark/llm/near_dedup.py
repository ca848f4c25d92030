"""MinHash near-duplicate classes.

Set of a document: its distinct five-word shingles (A-Z lower-cased) as 64-bit
hashes; with fewer words, the whole sequence; without words, empty. Documents are
linked when 100 * intersection >= 75 * union.

1. Every set gets PERMUTATIONS minima of universal hashes (a*x + b mod 2**64,
   upper half), cut into BANDS bands. Documents with equal sets are represented
   by the one with the lowest id from here on.
2. In a band bucket each member is paired with the lowest one, so a group of copies
   costs one pair per copy. Signatures of a pair must agree in at least
   AGREEMENT of the minima; the rest is compared on the full sets, in groups of
   a leader and at most MEMBERS members.
3. Components of these links by alternating large-star and small-star.
4. A bucket of three or more whose members are still in several components may hide
   a link that does not pass through its leader: its members meet in blocks
   (never a whole bucket in a task), where all intersections come from one product of
   incidence matrices and only a spanning forest of the new links is written.

A pair at exactly 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6; every
pair that shares a band and passes the signature check is decided on the full sets.
The check at AGREEMENT lies six standard deviations below 0.75.

Rows: null text counts as empty; an empty set is linked with nothing and forms a class
of its own. Rows with one doc_id are one document to the links, and each is returned.
A row without doc_id is alone (component_id null, kept). Extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import Hashes, IdFilter, mixed, raw_texts, stored, tidy
from .components import components

WORDS, PERMUTATIONS, BANDS = 5, 128, 32
AGREEMENT = 0.52
MEMBERS = 128  # beside a leader
MEETING = 512  # of a block of a bucket that is searched for further links
_RUN = 1 << 14


def shingles(words, hashes):
    """Sorted distinct shingle hashes of one document."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    n = max(1, len(h) - WORDS + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(h))):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mixed(h[i:i + n] + np.uint64(i + 1))
    return np.unique(mixed(total))


def universal_hashes(n=PERMUTATIONS, seed=7):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def minima(sets, a, b):
    """Signatures (one row of uint32 per set); the sets must not be empty."""
    out = np.empty((len(sets), len(a)), np.uint32)
    i = 0
    while i < len(sets):  # runs of sets that fit the cache together
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= _RUN):
            size += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j]) >> np.uint64(32)
        starts = np.cumsum([0] + [len(s) for s in sets[i:j - 1]])
        for k in range(len(a)):
            out[i:j, k] = np.minimum.reduceat((x * a[k] + b[k]) >> np.uint64(32), starts)
        i = j
    return out


def _sign(batches):
    hashes = Hashes()
    a, b = universal_hashes()
    rows = PERMUTATIONS // BANDS
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t.lower().split(), hashes) for t in raw_texts(part.column(1))]
            full = [k for k, s in enumerate(sets) if len(s)]
            sign = minima([sets[k] for k in full], a, b) if full else np.zeros((0, PERMUTATIONS), np.uint32)
            band = np.full((len(full), BANDS), np.uint64(1), np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
            for k in range(rows):
                band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + sign[:, k::rows].astype(np.uint64))
            keys, signs, bands = ([None] * len(sets) for _ in range(3))
            for r, k in enumerate(full):
                s = sets[k]
                with np.errstate(over="ignore"):
                    keys[k] = int(mixed(s).sum(dtype=np.uint64)).to_bytes(8, "little") + int(
                        np.bitwise_xor.reduce(mixed(s * np.uint64(3) + np.uint64(1)))).to_bytes(8, "little")
                signs[k], bands[k] = sign[r].tobytes(), band[r].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "sign", "bands"])


def _sets(batches):
    hashes = Hashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t.lower().split(), hashes).tobytes() for t in raw_texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "items"])


def _agree(batches):
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        u, v = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS)
                if batch.num_rows else np.zeros((0, PERMUTATIONS), np.uint32) for k in (2, 3))
        good = (u == v).mean(axis=1) >= AGREEMENT
        yield batch.select([0, 1]).filter(pa.array(good))


def similar(both, a, b):
    return 100 * both >= 75 * (a + b - both)


def _compare(table):
    """Members of one block against their leader (``lead`` marks its row)."""
    lead = table.column("lead").to_numpy()
    items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
    main = items[int(np.flatnonzero(lead)[0])]
    nodes, found = table.column("node").to_numpy(), []
    for k in np.flatnonzero(~lead.astype(bool)):
        both = len(np.intersect1d(main, items[k], assume_unique=True))
        if similar(both, len(main), len(items[k])):
            found.append(nodes[k])
    leader = table.column("leader")[0].as_py()
    return pa.table({"u": pa.array(found, pa.int64()), "v": pa.array([leader] * len(found), pa.int64())})


class _Forest:
    def __init__(self, labels):
        self.up = {}
        self.labels = labels

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            x = y
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _meet(table):
    """New links between different components in one pair of blocks of a bucket."""
    first = table.column("side_a").to_numpy(zero_copy_only=False).astype(bool)
    second = table.column("side_b").to_numpy(zero_copy_only=False).astype(bool)
    nodes, roots = table.column("node").to_numpy(), table.column("root").to_numpy()
    items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
    sizes = np.array([len(x) for x in items])
    flat = np.concatenate(items)
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(items)), sizes)
    shared = seen[column] > 1
    names, column = np.unique(column[shared], return_inverse=True)
    row = row[shared]
    a, b = np.flatnonzero(first), np.flatnonzero(second)
    both = np.zeros((len(a), len(b)), np.float32)
    slot = np.zeros(len(items), np.int64)
    for at in range(0, len(names), 4096):  # stripes of the shared shingles
        own = (column >= at) & (column < at + 4096)
        part = np.zeros((len(items), min(4096, len(names) - at)), np.float32)
        part[row[own], column[own] - at] = 1
        both += part[a] @ part[b].T
    slot[b] = np.arange(len(b))
    close = similar(both.astype(np.int64), sizes[a][:, None], sizes[b][None, :]) & (roots[a][:, None] != roots[b][None, :])
    forest, links = _Forest(roots), []
    for i, j in zip(*np.nonzero(close), strict=True):
        if forest.join(int(roots[a[i]]), int(roots[b[j]])):
            links.append((nodes[a[i]], nodes[b[j]]))
    return pa.table({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})


def _leader_links(bands, signs, sets):
    """Verified links of bucket members with the lowest member of their bucket."""
    leaders = bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = (bands.join(leaders, "bucket").where("node <> leader").select("node", "leader").distinct())
    pairs = (pairs.join(signs, "node")
             .join(signs.select(F.col("node").alias("leader"), F.col("sign").alias("lead_sign")), "leader")
             .select("node", "leader", "sign", "lead_sign").mapInArrow(_agree, "node long, leader long"))
    pairs = stored(pairs, "near-pairs")
    blocks = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("n"))
    block = F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("block")
    members = pairs.join(blocks, "leader").select("leader", block, "node")
    heads = (members.select("leader", "block").distinct()
             .select("leader", "block", F.col("leader").alias("node"), F.lit(1).alias("lead")))
    both = members.withColumn("lead", F.lit(0)).unionByName(heads).join(sets, "node")
    return both.select("leader", "block", "node", "lead", "items").groupBy("leader", "block").applyInArrow(
        _compare, "u long, v long")


def _rest_links(bands, star, sets):
    """Links between components that share a bucket of three or more."""
    rooted = bands.join(star, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed_buckets = (rooted.groupBy("bucket")
                     .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"),
                          F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("key"))
                     .where("n > 2 AND low <> high"))
    # a bucket met in several bands with the same members is met once
    mixed_buckets = mixed_buckets.groupBy("key", "n").agg(F.min("bucket").alias("bucket"))
    blocks = F.ceil(F.col("n") / MEETING).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    rows = (rooted.join(mixed_buckets.select("bucket", blocks.alias("blocks")), "bucket")
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root",
                    (F.col("own") <= F.col("other")).alias("side_a"), (F.col("own") >= F.col("other")).alias("side_b")))
    return rows.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(_meet, "u long, v long")


def near_groups(docs):
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    signed = stored(docs.mapInArrow(
        tidy(_sign), "doc_id long, n_shingles long, set_key binary, sign binary, bands array<long>"), "near-signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = full.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    copies = (full.select("doc_id", "set_key").join(same, "set_key").where("doc_id <> node")
              .select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    reps = same.select("node").distinct()
    bands = stored(reps.join(full.select(F.col("doc_id").alias("node"), "bands"), "node")
                   .select("node", F.explode("bands").alias("bucket")).distinct(), "near-bands")
    # only buckets with several members matter from here on
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    bands = stored(bands.join(shared, "bucket"), "near-shared")
    signs = full.select(F.col("doc_id").alias("node"), "sign").dropDuplicates(["node"])
    candidates = bands.select("node").distinct()
    sets = (IdFilter(candidates, "node").rows(docs.where("doc_id IS NOT NULL"))
            .mapInArrow(tidy(_sets), "node long, items binary").where("length(items) > 0"))
    sets = stored(sets.join(candidates, "node", "left_semi").dropDuplicates(["node"]), "near-sets")
    links = stored(_leader_links(bands, signs, sets), "near-links")
    star = components(links)
    more = stored(_rest_links(bands, star, sets), "near-links")
    if not more.isEmpty():
        star = components(star.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    # a copy belongs where its representative does
    star = star.unionByName(copies.join(star, copies["v"] == star["node"], "left").select(
        F.col("u").alias("node"), F.coalesce("root", "v").alias("root")))
    star = star.groupBy("node").agg(F.min("root").alias("root"))
    met = signed.join(star, signed["doc_id"] == star["node"], "left")
    root = F.coalesce("root", "doc_id")
    return met.select("doc_id", "n_shingles", root.alias("component_id"),
                      F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def one_of_each(docs):
    """``docs`` with one document of each near-duplicate class, all columns kept."""
    lost = near_groups(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)
