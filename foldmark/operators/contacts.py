"""Contact maps as sparse pixels: balancing, expected, log-OE, quality masks, tiles.

Per-bin facts (weights, quality) and per-distance facts (expected) are packed
into one row of arrays per sample and chromosome, a *profile*. An array is as
long as the chromosome has bins, so its size is fixed by the genome, not by the
data. The pixel table then joins its profile once, on (sample, chromosome),
instead of joining bins twice and expected once; with few profiles Spark
broadcasts them, with many it sort-merges and splits the skewed ones.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .. import constants as C
from ..functions.names import chromosome_index

AT = ["sample_id", "chrom"]
STRIPE = 2048  # bins a side of a part of the contact map: at most 4 million pixels
_FLOOR = -C.OE_CLIP  # log2 of an empty cell, clipped


def _packed(df, keys, index, value):
    """Values ordered by a complete 0..n-1 index, as one array per key."""
    rows = F.sort_array(F.collect_list(F.struct(index, value)))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r[value]).alias(value))


def bin_profiles(bins: DataFrame) -> DataFrame:
    """Profile with ``weights`` and ``n_bins``; bins must be listed from 0 without gaps."""
    return (_packed(bins, AT, "bin", "weight").withColumnRenamed("weight", "weights")
            .withColumn("n_bins", F.size("weights")))


def balanced(pixels: DataFrame, profiles: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """Pixels with ``value`` = count x weight x weight (NULL where a weight is) and ``dist``.

    One sample's chromosome may hold a third of all pixels, and an aggregation by the same key right after the join would keep
    Spark from splitting that key by itself. So the map is cut into squares of ``stripe`` bins: a pixel knows its square, and a profile
    is repeated per square, which for up to ``stripe`` bins is no copy at all.
    """
    w = lambda b: F.get("weights", F.col(b).cast("int"))
    square = lambda b: F.floor(b / stripe).cast("int")
    left = (pixels.withColumn("_row", square(F.least("bin1", "bin2"))).withColumn("_column", square(F.greatest("bin1", "bin2"))))
    last = square(F.greatest(F.col("n_bins") - 1, F.lit(0)))
    right = (profiles.withColumn("_row", F.explode(F.sequence(F.lit(0), last)))
             .withColumn("_column", F.explode(F.sequence(F.col("_row"), last))))
    return (left.join(right, AT + ["_row", "_column"]).drop("_row", "_column")
            .withColumn("value", F.col("cnt") * w("bin1") * w("bin2"))
            .withColumn("dist", (F.col("bin2") - F.col("bin1")).cast("int")))


@F.pandas_udf(ArrayType(LongType()))
def _pairs_at_distance(weights: pd.Series) -> pd.Series:
    """Number of bin pairs with two weights, per distance: autocorrelation of the mask."""
    out = []
    for w in weights:
        ok = ~pd.isna(np.asarray(w, dtype=object)) if len(w) else np.zeros(0, bool)
        n = len(ok)
        size = 1 << (2 * n).bit_length()
        f = np.fft.rfft(ok.astype(np.float64), size)
        out.append(np.rint(np.fft.irfft(f * np.conj(f), size)[:n]).astype(np.int64))
    return pd.Series(out)


def valid_pairs(profiles: DataFrame) -> DataFrame:
    return profiles.select(*AT, F.posexplode(_pairs_at_distance("weights")).alias("dist", "n_valid"))


def expected(pixels: DataFrame, bins: DataFrame, ignore_diags: int = 0) -> DataFrame:
    """Mean balanced contact per distance over all valid bin pairs, empty ones included.

    ``ignore_diags=2`` leaves the first two distances undefined, as the
    balanced expected of the usual contact tools does; 0 is the plain mean.
    """
    p = bin_profiles(bins)
    return _expected(balanced(pixels, p), p, ignore_diags)


def _expected(values, profiles, ignore_diags):
    sums = values.groupBy(*AT, "dist").agg(F.sum("value").alias("s"))
    mean = F.coalesce(F.col("s"), F.lit(0.0)) / F.nullif(F.col("n_valid"), F.lit(0))
    return (valid_pairs(profiles).join(sums, AT + ["dist"], "left")
            .select(*AT, "dist", F.when(F.col("dist") >= ignore_diags, mean).alias("expected")))


def expected_positive(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """Mean of the positive balanced contacts per distance (the fallback of the query tool)."""
    return (balanced(pixels, bin_profiles(bins)).where("value > 0")
            .groupBy(*AT, "dist").agg(F.avg("value").alias("expected")))


def oe_profiles(pixels: DataFrame, bins: DataFrame, quality: DataFrame | None = None, ignore_diags: int = 2,
                positive: bool = False) -> DataFrame:
    """Profile with weights, expected per distance and, if given, bin quality per chromosome."""
    p = bin_profiles(bins)
    if positive:
        every = p.select(*AT, F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("dist"))
        e = every.join(expected_positive(pixels, bins), AT + ["dist"], "left")
    else:
        e = _expected(balanced(pixels, p), p, ignore_diags)
    out = p.join(_packed(e, AT, "dist", "expected"), AT)
    if quality is not None:
        out = out.join(_packed(quality, ["chrom"], "bin", "valid"), "chrom", "left")
    return out


def log_oe_value(value, expected_value):
    """log2(OE + 1e-6) clipped to +-5; no expected gives OE 0, a missing value gives 0 after the log."""
    oe = F.when(expected_value > 0, value / expected_value).otherwise(0.0)
    log = F.log2(oe + F.lit(C.OE_FLOOR))
    clipped = F.greatest(F.lit(-C.OE_CLIP), F.least(F.lit(C.OE_CLIP), log))
    # greatest and least skip NULL, so the missing value is tested first
    return F.when(oe.isNull() | F.isnan(oe), 0.0).otherwise(clipped)


def log_oe(pixels: DataFrame, profiles: DataFrame, masked: bool = False) -> DataFrame:
    """Stored pixels as log observed/expected; ``masked`` zeroes rows and columns of bad bins."""
    v = balanced(pixels, profiles)
    out = v.withColumn("log_oe", log_oe_value(F.col("value"), F.get("expected", F.col("dist"))))
    if masked:
        ok = lambda b: F.coalesce(F.get("valid", F.col(b).cast("int")), F.lit(True))
        out = out.withColumn("log_oe", F.when(ok("bin1") & ok("bin2"), F.col("log_oe")).otherwise(0.0))
    return out.select(*AT, "bin1", "bin2", "log_oe")


# ---- bin quality -----------------------------------------------------------

def bad_bins(cytoband: DataFrame, chromosomes: DataFrame, resolution: int = C.RESOLUTION,
             telomere_bins: int = C.TELOMERE_BINS) -> DataFrame:
    """Bins under bad stains (with one bin beyond the band) or at the chromosome ends.

    ``chromosomes`` has chrom and n_bins.
    """
    last = F.col("n_bins") - 1
    lo = F.floor(F.col("start_bp") / resolution).cast("long")
    hi = F.least(F.ceil(F.col("end_bp") / resolution).cast("long"), last.cast("long"))
    bands = (cytoband.where(F.col("giestain").isin(C.BAD_STAINS)).join(chromosomes, "chrom")
             .select("chrom", F.greatest(F.lit(0).cast("long"), lo).alias("a"), hi.alias("b")))
    zero = F.lit(0).cast("long")
    ends = chromosomes.select("chrom", F.inline(F.array(
        F.struct(zero.alias("a"), F.least(F.lit(telomere_bins - 1).cast("long"), last.cast("long")).alias("b")),
        F.struct(F.greatest(zero, (F.col("n_bins") - telomere_bins).cast("long")).alias("a"),
                 last.cast("long").alias("b")))))
    return (bands.unionByName(ends).where("a <= b")
            .select("chrom", F.explode(F.sequence("a", "b")).alias("bin")).distinct())


def bin_quality(cytoband: DataFrame, chromosomes: DataFrame, resolution: int = C.RESOLUTION,
                telomere_bins: int = C.TELOMERE_BINS) -> DataFrame:
    """Every bin of every chromosome with its validity."""
    every = chromosomes.select("chrom", F.explode(F.sequence(
        F.lit(0).cast("long"), (F.col("n_bins") - 1).cast("long"))).alias("bin"))
    bad = bad_bins(cytoband, chromosomes, resolution, telomere_bins).withColumn("_bad", F.lit(True))
    return every.join(bad, ["chrom", "bin"], "left").select("chrom", "bin", F.col("_bad").isNull().alias("valid"))


def coverage(quality: DataFrame, resolution: int = C.RESOLUTION) -> DataFrame:
    n = quality.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_total"), F.count_if("valid").alias("n_good"))
    return (n.withColumn("pct", F.col("n_good") * 100.0 / F.greatest("n_total", F.lit(1)))
            .withColumn("span_mb", F.col("n_total") * resolution / 1e6)
            .withColumn("good_mb", F.col("n_good") * resolution / 1e6))


# ---- tiles -----------------------------------------------------------------

def _starts(n, size, step):
    """Tile starts 0, step, ... while start + size <= n; none when the chromosome is shorter."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(step)))


def tile_frames(profiles: DataFrame, size: int = C.TILE_SIZE, step: int = C.TILE_STEP,
                min_valid: float | None = C.MIN_VALID_FRAC) -> DataFrame:
    """One row per tile with the profile parts it needs; ``min_valid`` drops tiles of bad bins."""
    t = profiles.select("*", F.explode(_starts(F.col("n_bins"), size, step)).alias("start_bin"))
    cut = lambda c: F.slice(c, F.col("start_bin") + 1, size)
    ok = F.transform(cut("weights"), lambda w: w.isNotNull())
    has = "valid" in profiles.columns
    good = F.coalesce(cut("valid"), F.array_repeat(F.lit(True), size)) if has else F.array_repeat(F.lit(True), size)
    out = t.select(*AT, "start_bin", ok.alias("balanced_bin"), good.alias("good_bin"),
                   F.transform(F.slice("expected", 1, size), lambda e: F.coalesce(e > 0, F.lit(False))).alias("has_expected"))
    frac = F.size(F.filter("good_bin", lambda g: g)) / F.lit(size)
    out = out.withColumn("valid_fraction", frac)
    return out if min_valid is None else out.where(F.col("valid_fraction") >= min_valid)


def tile_cells(values: DataFrame, size: int = C.TILE_SIZE, step: int = C.TILE_STEP) -> DataFrame:
    """Pixels assigned to the tiles that hold them, by arithmetic on the bins; far pixels drop out first."""
    lo = F.greatest(F.lit(0), F.ceil((F.col("bin2") - size + 1) / step)).cast("int") * step
    hi = F.floor(F.col("bin1") / step).cast("int") * step
    near = values.where(F.col("bin2") - F.col("bin1") < size)
    return (near.where(lo <= hi).withColumn("start_bin", F.explode(F.sequence(lo, hi, F.lit(step))))
            .withColumn("i", (F.col("bin1") - F.col("start_bin")).cast("int"))
            .withColumn("j", (F.col("bin2") - F.col("start_bin")).cast("int")))


def tiles(values: DataFrame, profiles: DataFrame, size: int = C.TILE_SIZE, step: int = C.TILE_STEP,
          min_valid: float | None = C.MIN_VALID_FRAC, resolution: int = C.RESOLUTION) -> DataFrame:
    """Dense symmetric tiles of log-OE values, row-major in ``matrix``.

    Cells without a pixel are filled as the dense computation would: -5 where
    the contact is zero or the distance has no expected, 0 where a bin has no
    weight, 0 on masked rows and columns. A tile holds at most
    size x (size + 1) / 2 pixels, which bounds every group.
    """
    cell = F.struct((F.col("i") * size + F.col("j")).alias("at"), F.col("log_oe").cast("float").alias("v"))
    cells = tile_cells(values, size, step).groupBy(*AT, "start_bin").agg(F.collect_list(cell).alias("cells"))
    frames = tile_frames(profiles, size, step, min_valid).join(cells, AT + ["start_bin"], "left")
    schema = "sample_id string, chrom string, start_bin int, valid_fraction double, matrix array<float>"
    dist = np.abs(np.arange(size)[:, None] - np.arange(size)[None, :])

    at_once = max(1, 4_000_000 // (size * size))

    def flags(part, name):
        return part.column(name).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, size)

    def dense(batches):
        for b in batches:
            for lo in range(0, b.num_rows, at_once):
                part = b.slice(lo, at_once)
                n = part.num_rows
                ok, good, known = (flags(part, c) for c in ("balanced_bin", "good_bin", "has_expected"))
                m = np.where(known[:, dist] & ~(ok[:, :, None] & ok[:, None, :]), np.float32(0.0), np.float32(_FLOOR))
                cells = part.column("cells")
                flat = cells.flatten()
                at = flat.field("at").to_numpy(zero_copy_only=False)
                v = flat.field("v").to_numpy(zero_copy_only=False)
                tile = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False))
                m[tile, at // size, at % size] = v
                m[tile, at % size, at // size] = v
                m *= good[:, :, None] & good[:, None, :]
                m += 0.0  # no minus zero on masked cells
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size * size, pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("sample_id", "chrom", "start_bin", "valid_fraction")] + [flat],
                    names=["sample_id", "chrom", "start_bin", "valid_fraction", "matrix"])

    out = frames.select(*AT, "start_bin", "valid_fraction", "balanced_bin", "good_bin", "has_expected",
                        "cells").mapInArrow(dense, schema)
    s = F.col("start_bin").cast("long")
    return out.select("sample_id", F.col("chrom").alias("chr"), s.alias("start_bin"), (s + size).alias("end_bin"),
                      (s * resolution).alias("start_bp"), ((s + size) * resolution).alias("end_bp"),
                      "valid_fraction", "matrix")


def band_cells(size: int, width: int) -> int:
    """Cells of a size x size tile within ``width`` of the diagonal."""
    w = min(width, size - 1)
    return size + 2 * sum(size - k for k in range(1, w + 1))


def band_fraction(values: DataFrame, profiles: DataFrame, size: int = C.TILE_SIZE, step: int = C.TILE_STEP,
                  width: int = 20) -> DataFrame:
    """Share of positive cells near the diagonal per tile; only stored pixels can be positive."""
    near = tile_cells(values.where((F.col("log_oe") > 0) & (F.col("bin2") - F.col("bin1") <= width)), size, step)
    n = near.groupBy(*AT, "start_bin").agg(
        F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(2)).alias("_n"))
    frames = profiles.select(*AT, F.explode(_starts(F.col("n_bins"), size, step)).alias("start_bin"))
    return (frames.join(n, AT + ["start_bin"], "left")
            .select(*AT, "start_bin", (F.coalesce("_n", F.lit(0)) / F.lit(float(band_cells(size, width))))
                    .alias("band_fraction")))


def diagonal_pool(matrix, size: int, width: int = 5):
    """Row means over a band of the diagonal, cells outside the tile counting as 0."""
    def row(i):
        lo, hi = F.greatest(F.lit(0), i - width), F.least(F.lit(size - 1), i + width)
        band = F.slice(matrix, i * size + lo + 1, hi - lo + 1)
        return F.aggregate(band, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.lit(float(2 * width + 1))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), row)


def assay_decay(values: DataFrame, assay, value: str = "oe") -> DataFrame:
    """OE values brought from the assay's distance decay to the reference decay."""
    ref = C.ASSAY_SLOPES["bulk_hic"]
    slopes = F.create_map(*[F.lit(x) for kv in C.ASSAY_SLOPES.items() for x in kv])
    shift = F.coalesce(F.try_element_at(slopes, assay), F.lit(ref)) - F.lit(ref)
    d = F.abs(F.col("bin2") - F.col("bin1"))
    return values.withColumn(value, F.when(d >= 1, F.col(value) * F.pow(d.cast("double"), shift)).otherwise(F.col(value)))


def transpose_some(tiles: DataFrame, key, size: int = C.TILE_SIZE, seed: int = C.SEED) -> DataFrame:
    """Half of the tiles transposed, chosen by a hash of the key: the same ones on every run."""
    from ..functions.vectors import transpose_square
    chosen = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(2)) == 0
    return (tiles.withColumn("transposed", chosen)
            .withColumn("matrix", F.when(F.col("transposed"), transpose_square(F.col("matrix"), size))
                        .otherwise(F.col("matrix"))))


def present_chromosomes(df: DataFrame, chrom: str = "chrom") -> DataFrame:
    """Listed chromosomes that occur in the data, in list order."""
    at = chromosome_index(F.col(chrom))
    return (df.select(F.col(chrom).alias("chrom"), at.alias("position")).distinct()
            .where("position IS NOT NULL").orderBy("position"))
