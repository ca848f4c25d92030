"""Contact maps: expected, log-OE, quality, tiles."""

from pyspark.sql import functions as F

from ..fixtures import N_BINS, STEP, TILE
from ..operators import contacts as K
from ..plans import build
from .base import define, r6, registry

QUERIES, ORACLES, register = registry()

define("bal", """
SELECT p.sample_id, p.chrom, p.bin1, p.bin2, p.bin2 - p.bin1 AS dist, p.cnt*a.weight*b.weight AS value
FROM pixels p JOIN bins a ON a.sample_id = p.sample_id AND a.chrom = p.chrom AND a.bin = p.bin1
JOIN bins b ON b.sample_id = p.sample_id AND b.chrom = p.chrom AND b.bin = p.bin2""", ["pixels", "bins"])
define("npairs", """
SELECT a.sample_id, a.chrom, b.bin - a.bin AS dist, count(*) AS n FROM bins a JOIN bins b
  ON a.sample_id = b.sample_id AND a.chrom = b.chrom AND b.bin >= a.bin
WHERE a.weight IS NOT NULL AND b.weight IS NOT NULL GROUP BY 1,2,3""", ["bins"])
define("ex", """
SELECT n.sample_id, n.chrom, n.dist, coalesce(s.s, 0)/n.n AS expected FROM npairs n
LEFT JOIN (SELECT sample_id, chrom, dist, sum(value) AS s FROM bal GROUP BY 1,2,3) s USING (sample_id, chrom, dist)""",
       ["npairs", "bal"])
define("loge", """
SELECT b.sample_id, b.chrom, b.bin1, b.bin2, CASE WHEN e.expected > 0 AND b.value IS NULL THEN 0.0E0
  ELSE greatest(-5.0E0, least(5.0E0, log2(CASE WHEN e.expected > 0 THEN b.value/e.expected ELSE 0.0E0 END + 1e-6)))
  END AS log_oe
FROM bal b LEFT JOIN (SELECT * FROM ex WHERE dist >= 2) e USING (sample_id, chrom, dist)""", ["bal", "ex"])
define("bad", """
SELECT DISTINCT chrom, bin FROM (
  SELECT chrom, unnest(range(greatest(0, start_bp // 100000), least((end_bp + 99999) // 100000 + 1, 96))) AS bin
  FROM cytoband WHERE giestain IN ('acen', 'gvar', 'stalk') AND chrom IN (SELECT chrom FROM pixels)
  UNION ALL SELECT chrom, unnest([0, 1, 2, 93, 94, 95]) FROM (SELECT DISTINCT chrom FROM pixels))""",
       ["cytoband", "pixels"])
define("masked", """
SELECT l.sample_id, l.chrom, l.bin1, l.bin2, CASE WHEN x.bin IS NULL AND y.bin IS NULL THEN l.log_oe ELSE 0.0E0 END AS log_oe
FROM loge l LEFT JOIN bad x ON x.chrom = l.chrom AND x.bin = l.bin1
LEFT JOIN bad y ON y.chrom = l.chrom AND y.bin = l.bin2""", ["loge", "bad"])
define("frames", """
SELECT s.sample_id, s.chrom, t.start_bin, f.valid_fraction
FROM (SELECT DISTINCT sample_id, chrom FROM bins) s
CROSS JOIN (SELECT unnest([0, 16, 32, 48, 64]) AS start_bin) t
JOIN (SELECT c.chrom, t.start_bin, 1 - count(b.bin)/32.0E0 AS valid_fraction
  FROM (SELECT DISTINCT chrom FROM bins) c CROSS JOIN (SELECT unnest([0, 16, 32, 48, 64]) AS start_bin) t
  LEFT JOIN bad b ON b.chrom = c.chrom AND b.bin BETWEEN t.start_bin AND t.start_bin + 31 GROUP BY 1,2) f
  ON f.chrom = s.chrom AND f.start_bin = t.start_bin""", ["bins", "bad"])
# every cell of every tile, filled by the dense rules
define("cells", """
SELECT f.sample_id, f.chrom, f.start_bin, i.bin - f.start_bin AS i, j.bin - f.start_bin AS j,
  CAST(CAST(CASE WHEN bi.bin IS NOT NULL OR bj.bin IS NOT NULL THEN 0.0E0
       WHEN l.log_oe IS NOT NULL THEN l.log_oe
       WHEN e.expected > 0 AND (i.weight IS NULL OR j.weight IS NULL) THEN 0.0E0
       ELSE -5.0E0 END AS FLOAT) AS DOUBLE) AS v
FROM frames f
JOIN bins i ON i.sample_id = f.sample_id AND i.chrom = f.chrom AND i.bin BETWEEN f.start_bin AND f.start_bin + 31
JOIN bins j ON j.sample_id = f.sample_id AND j.chrom = f.chrom AND j.bin BETWEEN f.start_bin AND f.start_bin + 31
LEFT JOIN bad bi ON bi.chrom = f.chrom AND bi.bin = i.bin
LEFT JOIN bad bj ON bj.chrom = f.chrom AND bj.bin = j.bin
LEFT JOIN loge l ON l.sample_id = f.sample_id AND l.chrom = f.chrom AND l.bin1 = least(i.bin, j.bin)
  AND l.bin2 = greatest(i.bin, j.bin)
LEFT JOIN ex e ON e.sample_id = f.sample_id AND e.chrom = f.chrom AND e.dist = abs(i.bin - j.bin) AND e.dist >= 2
WHERE f.valid_fraction >= 0.2""", ["frames", "bins", "bad", "loge", "ex"])


def _chromosomes(fx):
    return fx.pixels.select("chrom").distinct().withColumn("n_bins", F.lit(N_BINS))


def _profiles(fx, quality=True):
    q = K.bin_quality(fx.cytoband, _chromosomes(fx)) if quality else None
    return K.oe_profiles(fx.pixels, fx.bins, q)


def _tiles(fx):
    return build.build_tiles(fx.pixels, fx.bins, fx.cytoband, _chromosomes(fx), size=TILE, step=STEP)


_EX = "SELECT sample_id, chrom, CAST(dist AS INTEGER) AS dist, round(expected, 6) AS expected FROM ex"


@register("expected_by_distance", _EX + " WHERE dist >= 2", ["ex"])
def expected_by_distance(fx):
    return (K.expected(fx.pixels, fx.bins, ignore_diags=2).where("expected IS NOT NULL")
            .select("sample_id", "chrom", "dist", r6("expected")))


@register("expected_nanmean", _EX, ["ex"])
def expected_nanmean(fx):
    return (K.expected(fx.pixels, fx.bins).where("expected IS NOT NULL")
            .select("sample_id", "chrom", "dist", r6("expected")))


@register("expected_positive", """
SELECT sample_id, chrom, CAST(dist AS INTEGER) AS dist, round(avg(value), 6) AS expected
FROM bal WHERE value > 0 GROUP BY 1,2,3""", ["bal"])
def expected_positive(fx):
    return K.expected_positive(fx.pixels, fx.bins).select("sample_id", "chrom", "dist", r6("expected"))


@register("log_oe", "SELECT sample_id, chrom, bin1, bin2, round(log_oe, 6) + 0.0E0 AS log_oe FROM loge", ["loge"])
def log_oe(fx):
    return K.log_oe(fx.pixels, _profiles(fx, False)).select("sample_id", "chrom", "bin1", "bin2", r6("log_oe"))


@register("bad_bins", "SELECT chrom, bin FROM bad", ["bad"])
def bad_bins(fx):
    return K.bad_bins(fx.cytoband, _chromosomes(fx))


@register("coverage", """
SELECT chrom, 96 AS n_total, 96 - count(*) AS n_good, round((96 - count(*))*100.0E0/96, 6) AS pct,
  round((96 - count(*))*0.1E0, 6) AS good_mb FROM bad GROUP BY 1""", ["bad"])
def coverage(fx):
    q = K.bin_quality(fx.cytoband, _chromosomes(fx))
    return K.coverage(q).select("chrom", F.col("n_total").cast("int").alias("n_total"), "n_good", r6("pct"), r6("good_mb"))


@register("masked_oe", "SELECT sample_id, chrom, bin1, bin2, round(log_oe, 6) + 0.0E0 AS log_oe FROM masked", ["masked"])
def masked_oe(fx):
    return K.log_oe(fx.pixels, _profiles(fx), masked=True).select("sample_id", "chrom", "bin1", "bin2", r6("log_oe"))


@register("tiles", """
SELECT c.sample_id, c.chrom AS chr, c.start_bin, CAST(c.start_bin + 32 AS BIGINT) AS end_bin,
  CAST(c.start_bin*100000 AS BIGINT) AS start_bp, CAST((c.start_bin + 32)*100000 AS BIGINT) AS end_bp,
  round(f.valid_fraction, 6) AS valid_fraction, count(*) AS n_cells, count(*) FILTER (v = -5) AS n_floor,
  count(*) FILTER (v = 0) AS n_zero, round(sum(v), 6) + 0.0E0 AS total
FROM (SELECT * REPLACE (CAST(start_bin AS BIGINT) AS start_bin) FROM cells) c
JOIN frames f ON f.sample_id = c.sample_id AND f.chrom = c.chrom AND f.start_bin = c.start_bin
GROUP BY ALL""", ["cells", "frames"])
def tiles(fx):
    count = lambda x: F.size(F.filter("matrix", lambda v: v == x)).cast("long")
    total = F.aggregate("matrix", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return _tiles(fx).select(
        "sample_id", "chr", "start_bin", "end_bin", "start_bp", "end_bp", r6("valid_fraction"),
        F.size("matrix").cast("long").alias("n_cells"), count(-5.0).alias("n_floor"), count(0.0).alias("n_zero"),
        (F.round(total, 6) + F.lit(0.0)).alias("total"))


@register("tile_cells", """
SELECT sample_id, chrom AS chr, CAST(start_bin AS BIGINT) AS start_bin, CAST(i*32 + j AS INTEGER) AS cell,
  round(v, 6) + 0.0E0 AS v FROM cells""", ["cells"])
def tile_cells(fx):
    t = _tiles(fx).select("sample_id", "chr", "start_bin", F.posexplode("matrix").alias("cell", "v"))
    return t.select("sample_id", "chr", "start_bin", "cell", (F.round(F.col("v").cast("double"), 6) + F.lit(0.0)).alias("v"))


@register("diag_pool", """
SELECT sample_id, chrom AS chr, CAST(start_bin AS BIGINT) AS start_bin, CAST(i AS INTEGER) AS row,
  round(sum(CASE WHEN abs(i - j) <= 5 THEN v ELSE 0.0E0 END)/11, 6) + 0.0E0 AS pooled
FROM cells GROUP BY 1,2,3,4""", ["cells"])
def diag_pool(fx):
    t = _tiles(fx).select("sample_id", "chr", "start_bin",
                          F.posexplode(K.diagonal_pool(F.col("matrix"), TILE)).alias("row", "p"))
    return t.select("sample_id", "chr", "start_bin", "row", (F.round("p", 6) + F.lit(0.0)).alias("pooled"))


@register("band_valid_fraction", """
SELECT f.sample_id, f.chrom, CAST(f.start_bin AS INTEGER) AS start_bin, round(coalesce(n, 0)/892.0E0, 6) AS band_fraction
FROM frames f LEFT JOIN (
  SELECT f.sample_id, f.chrom, f.start_bin, sum(CASE WHEN bin1 = bin2 THEN 1 ELSE 2 END) AS n
  FROM frames f JOIN loge l ON l.sample_id = f.sample_id AND l.chrom = f.chrom AND l.bin1 >= f.start_bin
    AND l.bin2 < f.start_bin + 32 AND l.bin2 - l.bin1 <= 20 AND l.log_oe > 0 GROUP BY 1,2,3) USING (sample_id, chrom, start_bin)""",
          ["frames", "loge"])
def band_valid_fraction(fx):
    p = _profiles(fx, False)
    return K.band_fraction(K.log_oe(fx.pixels, p), p, TILE, STEP).select(
        "sample_id", "chrom", "start_bin", r6("band_fraction"))


@register("assay_decay", """
SELECT sample_id, chrom, bin1, bin2, round(CASE WHEN bin2 > bin1 THEN cnt*pow(bin2 - bin1,
  CASE sample_id WHEN 'S1' THEN -0.6 WHEN 'S2' THEN 0.2 ELSE 0 END) ELSE cnt END, 6) AS oe FROM pixels""", ["pixels"])
def assay_decay(fx):
    assay = F.when(F.col("sample_id") == "S1", "micro_c").when(F.col("sample_id") == "S2", "sc_hic").otherwise("bulk_hic")
    return K.assay_decay(fx.pixels.withColumn("oe", F.col("cnt")), assay).select("sample_id", "chrom", "bin1", "bin2", r6("oe"))


@register("tile_transpose", """
SELECT id, CAST(g AS INTEGER) AS cell, CAST(embedding[1 + (g % 8)*8 + g // 8] AS DOUBLE) AS v
FROM (SELECT vec_id AS id, embedding, unnest(range(0, 64)) AS g FROM embeddings)""")
def tile_transpose(fx):
    from ..functions.vectors import transpose_square
    t = fx.fingerprints.select("id", F.posexplode(transpose_square(F.col("fingerprint"), 8)).alias("cell", "v"))
    return t.select("id", "cell", F.col("v").cast("double").alias("v"))


# 64 values per tile: means of 16 consecutive cells
@register("tile_fingerprints", """
SELECT sample_id, chrom AS chr, CAST(start_bin*100000 AS BIGINT) AS start_bp,
  CAST((i*32 + j) // 16 AS INTEGER) AS dim, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 6) + 0.0E0 AS v
FROM cells GROUP BY 1,2,3,4""", ["cells"])
def tile_fingerprints(fx):
    """Any tile-to-vector callable over all tiles; here plain means."""
    f = build.encode_tiles(_tiles(fx), build.mean_projection(64)).select(
        "sample_id", "chr", "start_bp", F.posexplode("fingerprint").alias("dim", "v"))
    return f.select("sample_id", "chr", "start_bp", "dim", (F.round(F.col("v").cast("double"), 6) + F.lit(0.0)).alias("v"))


_ASSAYS = ["bulk_hic", "micro_c", "sc_hic", "chia_pet", "other"]


# the registry leaves out S7; every row of the combined set with its index, code and part
@register("combined_split", """
SELECT sample_id, chr, start_bin, CAST(dense_rank() OVER (ORDER BY sample_id) - 1 AS INTEGER) AS cell_idx,
  CAST(CASE sample_id WHEN 'S2' THEN 1 WHEN 'S3' THEN 2 WHEN 'S4' THEN 3 ELSE 0 END AS INTEGER) AS assay_id,
  CASE WHEN row_number() OVER (PARTITION BY sample_id ORDER BY md5(concat('42:', sample_id, ':', chr, ':', start_bin)))
    <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY sample_id)*0.1) AS BIGINT)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT sample_id, chrom AS chr, CAST(start_bin AS BIGINT) AS start_bin FROM frames WHERE valid_fraction >= 0.2)""", ["frames"])
def combined_split(fx):
    n = F.substring("sample_id", 2, 2).cast("int")
    registry = fx.pixels.select("sample_id").distinct().where("sample_id <> 'S7'").select(
        "sample_id", F.get(F.array(*[F.lit(a) for a in _ASSAYS]), (n - 1) % 5).alias("assay"))
    return build.combine(_tiles(fx), registry=registry).select("sample_id", "chr", "start_bin", "cell_idx", "assay_id", "split")
