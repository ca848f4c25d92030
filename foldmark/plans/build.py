"""Building the store: pixels to tiles, tiles to tables, combined training set."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import names as N
from ..operators import annotation, codes, contacts, tables
from ..sources.scratch import written


def build_tiles(pixels: DataFrame, bins: DataFrame, cytoband: DataFrame, chromosomes: DataFrame, *,
                size: int = C.TILE_SIZE, step: int = C.TILE_STEP, resolution: int = C.RESOLUTION,
                min_valid: float = C.MIN_VALID_FRAC, ignore_diags: int = 2) -> DataFrame:
    """Masked log-OE tiles of every sample and chromosome."""
    quality = contacts.bin_quality(cytoband, chromosomes, resolution)
    profiles = contacts.oe_profiles(pixels, bins, quality, ignore_diags)
    values = contacts.log_oe(pixels, profiles)
    return contacts.tiles(values, profiles, size, step, min_valid, resolution)


def preprocess(pixels: DataFrame, bins: DataFrame, cytoband: DataFrame, chromosomes: DataFrame, path: str, **kw):
    """Write the tiles of every (sample, chromosome) that has none yet under ``path``.

    Labels of earlier runs stay and new cell lines are numbered on: the map is taken over
    the stored tiles and all requested samples.
    """
    from ..sources import store
    spark = pixels.sparkSession
    asked = bins.select("sample_id", "chrom").distinct()
    names = asked.select(N.cell_name(F.col("sample_id")).alias("cell_line_name")).distinct()
    labels = tables.label_map(names, "cell_line_name")
    if store.Store(spark, path)._exists(path):
        stored = store.read_tiles(spark, path)
        asked = tables.not_done(asked, stored.select("sample_id", F.col("chr").alias("chrom")))
        known = stored.select("cell_line_name", F.col("cell_line_idx").alias("label")).distinct()
        labels = tables.label_map_with(known, names, "cell_line_name")
    on = ["sample_id", "chrom"]
    tiles = build_tiles(pixels.join(asked, on, "left_semi"), bins.join(asked, on, "left_semi"), cytoband, chromosomes, **kw)
    store.write_tiles(label_tiles(tiles, labels).withColumn("cell_line_idx", F.col("cell_line_idx").cast("int")), path)


def build_query_tiles(pixels: DataFrame, bins: DataFrame, *, size: int = C.TILE_SIZE, step: int = C.TILE_STEP,
                      resolution: int = C.RESOLUTION, min_band: float = 0.05) -> DataFrame:
    """Tiles as the query side makes them: no mask, kept by their near-diagonal share."""
    profiles = contacts.oe_profiles(pixels, bins, None)
    values = contacts.log_oe(pixels, profiles)
    keep = (contacts.band_fraction(values, profiles, size, step).where(F.col("band_fraction") >= min_band)
            .select("sample_id", F.col("chrom").alias("chr"), F.col("start_bin").cast("long").alias("start_bin")))
    return contacts.tiles(values, profiles, size, step, None, resolution).join(
        keep, ["sample_id", "chr", "start_bin"], "left_semi")


def label_tiles(tiles: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Tiles with canonical cell-line name and its label index (from ``labels``, else over these tiles)."""
    named = tiles.withColumn("cell_line_name", N.cell_name(F.col("sample_id")))
    index = tables.label_map(named, "cell_line_name") if labels is None else labels
    return named.join(index.withColumnRenamed("label", "cell_line_idx"), "cell_line_name")


def encode_tiles(tiles: DataFrame, encode, out: str = "fingerprint", dim: int = C.FP_DIM, batch: int = 64) -> DataFrame:
    """Vectors from any callable ``encode(float32[n, size*size]) -> float32[n, dim]``, labels kept.

    The callable runs on Arrow batches of tiles inside the tasks.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    kept = [f for f in tiles.schema.fields if f.name != "matrix"]
    schema = StructType(kept + [StructField(out, ArrayType(FloatType()))])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                col = part.column("matrix")
                m = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
                v = np.asarray(encode(m), dtype=np.float32).reshape(len(col), dim)
                flat = pa.ListArray.from_arrays(np.arange(0, dim * (len(col) + 1), dim, dtype=np.int32), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(n).cast(arrow.field(n).type) for n in names] + [flat.cast(arrow.field(out).type)],
                    schema=arrow)

    return tiles.mapInArrow(run, schema)


def build_store(tiles: DataFrame, encode, samples: DataFrame, existing: DataFrame, *, ccre: DataFrame | None = None,
                tokens: DataFrame | None = None, codebook: DataFrame | None = None, histograms: DataFrame | None = None,
                dim: int = C.FP_DIM) -> dict:
    """Fingerprint, sample, centroid and, with ``tokens`` and ``codebook``, histogram tables after ingesting the tiles.

    ``existing`` are the fingerprints already stored; new rows are numbered on. ``tokens`` (sample_id and token of every new tile) are
    coded by ``codebook`` (code, vec); a sample's histogram replaces the one in ``histograms``.
    """
    fps = encode_tiles(tiles.select("sample_id", "chr", "start_bp", "end_bp", "matrix"), encode, dim=dim)
    fps = (tables.with_new_ids(existing, fps, ["sample_id", "chr", "start_bp"])
           .withColumn("boundary", F.lit(None).cast("array<float>"))
           .withColumn("compartment", F.lit(None).cast("array<float>")))
    if ccre is None:
        fps = fps.withColumn("ccre_annot", F.lit(None).cast("array<float>"))
    else:
        w = fps.select("sample_id", F.col("chr").alias("chrom"), F.col("start_bp").alias("win_start"),
                       F.col("end_bp").alias("win_end")).distinct()
        a = annotation.annotate_windows(w, ccre).select(
            "sample_id", F.col("chrom").alias("chr"), F.col("win_start").alias("start_bp"),
            annotation.annotation_vector().alias("ccre_annot"))
        fps = fps.join(a, ["sample_id", "chr", "start_bp"], "left")
    cols = ["id", "sample_id", "chr", "start_bp", "end_bp", "fingerprint", "boundary", "compartment", "ccre_annot"]
    every = existing.select(*cols).unionByName(fps.select(*cols))
    centroids = tables.locus_centroids(every, dim)
    coded = {}
    if tokens is not None:
        n_codes = codebook.agg((F.max("code") + 1).alias("n")).first()["n"]
        fresh = sample_histograms(tokens.join(tiles.select("sample_id").distinct(), "sample_id", "left_semi"), codebook, ["sample_id"], n_codes)
        coded["sample_histograms"] = fresh if histograms is None else tables.upsert(histograms, fresh, "sample_id")
    return coded | {
        "window_fingerprints": every,
        "samples": tables.refresh_tile_counts(samples, every),
        "locus_centroids": centroids.withColumn("centroid", F.col("centroid").cast("array<float>")),
        "centroid_index": tables.centroid_index(centroids),
    }


def sample_histograms(tokens: DataFrame, codebook: DataFrame, key, n_codes: int = C.N_CODES) -> DataFrame:
    """Stored code histogram of every sample."""
    return codes.stored_histograms(codes.histograms(codes.assign_codes(tokens, codebook, key), n_codes=n_codes))


def combine(tiles: DataFrame, wanted: DataFrame | None = None, registry: DataFrame | None = None, *, fraction: float = 0.1,
            seed: int = C.SEED) -> DataFrame:
    """All tiles with assay code (``assay_id``), sample index (``cell_idx``) and a stratified train/val split.

    ``registry`` (sample_id, assay) gives the assay; unknown ones and samples without a row count as the first. What a tile needs to know
    is one row per sample: its index, code and the hash up to which its tiles are val. That table is sent to the tiles when
    it is small, so no matrix is shuffled; rows without a sample id are a sample of their own.
    """
    if wanted is not None:
        tiles = tiles.join(wanted.select("sample_id").distinct(), "sample_id", "left_semi")
    key = F.concat_ws(":", "sample_id", "chr", F.col("start_bin").cast("string"))
    keys = written(tiles.select("sample_id", key.alias("tile_key")), "tile-keys")
    cuts = tables.split_cuts(keys, "sample_id", "tile_key", fraction, seed)
    index = tables.label_map(keys, "sample_id")
    code = N.assay_code(F.col("assay"))
    assays = (index.select("sample_id", F.lit(None).cast("string").alias("assay")) if registry is None else
              registry.groupBy("sample_id").agg(F.min("assay").alias("assay"))).select(F.col("sample_id").alias("_a"), code.alias("assay_id"))
    facts = index.select(F.col("sample_id").alias("_s"), F.col("label").alias("cell_idx"))
    facts = facts.join(cuts, F.col("_s").eqNullSafe(F.col("sample_id"))).drop("sample_id")
    facts = facts.join(assays, F.col("_s").eqNullSafe(F.col("_a")), "left").select(
        "_s", "cell_idx", F.coalesce("assay_id", F.lit(0)).alias("assay_id"), "cut")
    met = tiles.join(tables.sent_if_small(facts), tiles["sample_id"].eqNullSafe(F.col("_s")))
    split = F.when(tables._split_mark(key, seed) <= F.col("cut"), "val").otherwise("train")
    return met.withColumn("split", split).select(*[tiles[c] for c in tiles.columns if c not in ("split", "cell_idx", "assay_id")],
                                                 "split", "cell_idx", "assay_id")


def mean_projection(dim: int):
    """A plain encoder for tests and first runs: means of ``dim`` equal slices of the tile."""
    def encode(m):
        return m.reshape(m.shape[0], dim, -1).mean(axis=2, dtype="float64")
    return encode

