"""Store maintenance and derived tables: upserts, counts, centroids, labels, splits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import vectors as V
from ..sources.scratch import written
from .ranks import numbered

MOST_SENT = 500_000  # rows of a few short values that are sent to every executor


def locus_centroids(fingerprints: DataFrame, dim: int = C.FP_DIM) -> DataFrame:
    """Element-wise mean vector (double; stored as float) and sample count of every locus, over rows with a usable vector."""
    return (fingerprints.where(V.usable(F.col("fingerprint"))).groupBy("chr", "start_bp", "end_bp")
            .agg(V.mean_vectors(F.col("fingerprint"), dim).alias("centroid"),
                 F.count(F.lit(1)).cast("int").alias("n_samples")))


def centroid_index(centroids: DataFrame) -> DataFrame:
    """L2-normalised centroids keyed by locus: the exact search table."""
    return centroids.select("chr", "start_bp", "end_bp",
                            V.unit(F.col("centroid"), 0.0).cast("array<float>").alias("vector"))


def group_mean_fingerprints(fingerprints: DataFrame, group: str, dim: int = C.FP_DIM) -> DataFrame:
    """Mean vector per replicate group and locus, over rows with a usable vector."""
    return (fingerprints.where(V.usable(F.col("fingerprint"))).groupBy(group, "chr", "start_bp", "end_bp")
            .agg(V.mean_vectors(F.col("fingerprint"), dim).alias("fingerprint"),
                 F.count(F.lit(1)).alias("n_samples")))


def insert_absent(existing: DataFrame, incoming: DataFrame, key) -> DataFrame:
    """Existing rows plus the incoming rows whose key is not there yet."""
    return existing.unionByName(new_rows(existing, incoming, key))


def new_rows(existing: DataFrame, incoming: DataFrame, key) -> DataFrame:
    key = [key] if isinstance(key, str) else list(key)
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti").select(*incoming.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key, order: str | None = None) -> DataFrame:
    """Incoming rows replace existing rows of the same key.

    Of several incoming rows of a key the one with the largest ``order`` wins, then
    (and without it) the one with the largest hash: the same one on every run.
    """
    key = [key] if isinstance(key, str) else list(key)
    latest = [F.desc(order)] if order else []
    newest = Window.partitionBy(*key).orderBy(*latest, F.desc(F.xxhash64(*incoming.columns)))
    one = incoming.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return existing.join(one.select(*key), key, "left_anti").select(*existing.columns).unionByName(one)


def without_samples(table: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows of the table whose sample is not being overwritten."""
    return table.join(samples.select("sample_id").distinct(), "sample_id", "left_anti").select(*table.columns)


def with_new_ids(existing: DataFrame, incoming: DataFrame, order) -> DataFrame:
    """Incoming rows numbered on from the largest existing id, in a total order."""
    base = existing.select(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ordered = dense_numbering(incoming, order)
    top = base.scalar()
    return ordered.withColumn("id", F.col("_row") + top).drop("_row")


def dense_numbering(df: DataFrame, order) -> DataFrame:
    """Column ``_row`` = 1..n in the given total order (nulls first), from range offsets."""
    return numbered(df, list(order), (), "_row").withColumn("_row", F.col("_row") + 1)


def first_in_hash_order(df: DataFrame, n: int, key, seed: int = C.SEED) -> DataFrame:
    """The n rows smallest by the md5 of "seed:key", numbered from 0 as ``_k``: a repeatable sample.

    Counts per hash bucket give the bucket in which the n-th row lies; only rows
    up to that bucket are sorted.
    """
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))
    rows = df.withColumn("_h", mark).withColumn("_b", F.substring("_h", 1, 4))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.select("_b", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before")).where(F.col("_before") < n)
    last = needed.agg(F.max("_b").alias("b")).scalar()  # windows: one row per bucket, then n rows and a bucket
    place = F.row_number().over(Window.orderBy("_b", "_h", *key)) - 1
    return rows.where(F.col("_b") <= last).withColumn("_k", place).where(F.col("_k") < n).drop("_h", "_b")


def refresh_tile_counts(samples: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Samples with n_tiles recounted; samples without fingerprints get 0."""
    n = fingerprints.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return (samples.join(n, "sample_id", "left")
            .withColumn("n_tiles", F.coalesce(F.col("_n"), F.lit(0))).drop("_n"))


def tile_counts(tiles: DataFrame) -> DataFrame:
    """Tiles per sample and the total, from the key columns alone."""
    return tiles.rollup("sample_id").agg(F.count(F.lit(1)).alias("n_tiles"))


def not_done(requested: DataFrame, done: DataFrame, key=("sample_id", "chrom")) -> DataFrame:
    """Requested work that is not finished yet."""
    return requested.join(done.select(*key).distinct(), list(key), "left_anti")


def present_samples(available: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Wanted samples that exist, or all samples, in name order."""
    names = available.select("sample_id").distinct()
    if wanted is not None:
        names = names.join(wanted.select("sample_id"), "sample_id", "left_semi")
    return names.orderBy("sample_id")


def label_map_with(old: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """A label map (column, label) kept as it is and continued with the names it lacks, in name order."""
    fresh = label_map(names.join(old.select(column), column, "left_anti"), column)
    top = old.select((F.coalesce(F.max("label"), F.lit(-1)) + 1).alias("n")).scalar()
    return old.select(column, "label").unionByName(fresh.select(column, (F.col("label") + top).cast("int").alias("label")))


def label_map(names: DataFrame, column: str) -> DataFrame:
    """Sorted distinct names numbered from 0, however many they are."""
    return numbered(names.select(column).distinct(), [column], (), "label").select(column, F.col("label").cast("int").alias("label"))


def split_cuts(rows: DataFrame, stratum: str, key: str, fraction: float = 0.1, seed: int = C.SEED) -> DataFrame:
    """Per stratum (null is one) the md5 up to which rows go to val: max(1, floor(n*fraction)) rows of distinct keys.

    Rows are counted by leading hex digits, three at a time: after two rounds only rows that agree with the cut in six digits, one in
    16 million, are ranked. What comes out is one row per stratum, so a split moves no row.
    """
    left = rows.select(F.col(stratum).alias("s"), _split_mark(F.col(key), seed).alias("h"))
    need = F.greatest(F.lit(1), F.floor(F.sum("c").over(Window.partitionBy("s")) * F.lit(fraction)))
    for digits in (3, 6):
        counts = left.groupBy("s", F.substring("h", 1, digits).alias("d"), *(["need"] if digits > 3 else [])).agg(F.count(F.lit(1)).alias("c"))
        upto = F.coalesce(F.sum("c").over(Window.partitionBy("s").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", upto).withColumn("need", need if digits == 3 else F.col("need"))
        at = counts.where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("c"))).select(
            F.col("s").alias("s_"), "d", (F.col("need") - F.col("before")).alias("n"))
        left = left.join(at, F.col("s").eqNullSafe(F.col("s_")) & (F.substring("h", 1, digits) == F.col("d"))).select(
            "s", "h", F.col("n").alias("need"))
    place = F.row_number().over(Window.partitionBy("s").orderBy("h"))
    return left.withColumn("place", place).where("place = need").select(F.col("s").alias(stratum), F.col("h").alias("cut"))


def _split_mark(key, seed):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def stratified_split(rows: DataFrame, stratum: str, key: str, fraction: float = 0.1, seed: int = C.SEED) -> DataFrame:
    """Column ``split``: per stratum (null is one) max(1, floor(n*fraction)) rows to val, rest to train.

    Rows are taken in the order of the md5 of seed and key; rows that share a key go together.
    """
    cuts = sent_if_small(split_cuts(rows, stratum, key, fraction, seed).withColumnRenamed(stratum, "_s"))
    met = rows.join(cuts, rows[stratum].eqNullSafe(F.col("_s")))
    split = F.when(_split_mark(rows[key], seed) <= F.col("cut"), "val").otherwise("train")
    return met.select(*[rows[c] for c in rows.columns if c != "split"], split.alias("split"))


def sent_if_small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``df`` as a stored table, marked for broadcast when a count shows at most ``most`` rows."""
    table = written(df, "small")
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def global_split(rows: DataFrame, key: str, fraction: float = 0.1, seed: int = C.SEED) -> DataFrame:
    """Random split of the whole table: max(1, floor(n * fraction)) rows to val, rest to train."""
    return stratified_split(rows.withColumn("_all", F.lit(0)), "_all", key, fraction, seed).drop("_all")
