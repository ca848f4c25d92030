"""Similarity search: at one locus, over a whole collection, and the fallback."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import labels as L
from ..functions import vectors as V
from . import blocks

LOCUS = ["chr", "start_bp"]
WINDOW_KEY = ["sample_id", "chr", "start_bp"]


def _reference_side(refs):
    return refs.select("chr", "start_bp", "sample_id", "cell_type", "tissue", "fingerprint")


def locus_matches(queries: DataFrame, refs: DataFrame, k: int = C.TOP_K, rows=None) -> DataFrame:
    """Top k references of every query window among those stored at the same locus.

    ``refs`` carries cell_type and tissue (fingerprints joined to samples).
    """
    q = queries.select("sample_id", "chr", "start_bp", "end_bp", "fingerprint")
    found = blocks.top_matches(q, _reference_side(refs), k, keys=LOCUS, q_key=WINDOW_KEY,
                               r_key="sample_id", rows=rows)
    return found.select(*WINDOW_KEY, "end_bp", "rank", "score",
                        F.col("ref_sample_id").alias("match_sample"),
                        F.col("ref_cell_type").alias("match_cell_type"),
                        F.col("ref_tissue").alias("match_tissue"),
                        L.similarity_class(F.col("score")).alias("status"))


def window_results(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per query window with its matches nested, best first.

    Windows without any match score 0 and have cell type ``unknown``.
    """
    one = F.struct("rank", F.col("match_sample").alias("sample_id"), "score",
                   F.col("match_cell_type").alias("cell_type"), F.col("match_tissue").alias("tissue"), "status")
    nested = matches.groupBy(*WINDOW_KEY).agg(F.sort_array(F.collect_list(one)).alias("top_matches"))
    best = F.get("top_matches", F.lit(0))
    return (queries.select(*WINDOW_KEY, "end_bp").join(nested, WINDOW_KEY, "left")
            .withColumn("similarity", F.coalesce(best["score"], F.lit(0.0)))
            .withColumn("top_sample", F.coalesce(best["sample_id"], F.lit("none")))
            .withColumn("top_cell_type", F.coalesce(best["cell_type"], F.lit("unknown")))
            .withColumn("has_match", F.col("top_matches").isNotNull())
            .withColumn("status", L.similarity_class(F.col("similarity"))))


def centroid_matches(queries: DataFrame, centroids: DataFrame, k: int = 1, rows=blocks.ROWS_PER_BLOCK) -> DataFrame:
    """k nearest locus centroids of every query window over the whole genome."""
    c = centroids.select(
        L.locus(F.col("chr"), F.col("start_bp"), F.col("end_bp")).alias("locus"), "chr", "start_bp", "end_bp",
        F.col("centroid").alias("fingerprint"))
    q = queries.select(*WINDOW_KEY, "end_bp", "fingerprint")
    return blocks.top_matches(q, c, k, q_key=WINDOW_KEY, r_key="locus", rows=rows)


def heldout_windows(queries: DataFrame, refs: DataFrame, centroids: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Window results where a locus without references falls back to the nearest centroid."""
    matches = locus_matches(queries, refs, k)
    stored = refs.select(*LOCUS).distinct()
    here = (matches.where("rank = 1")
            .select(*WINDOW_KEY, "end_bp", F.col("score").alias("similarity"),
                    F.col("match_sample").alias("top_sample"), F.col("match_cell_type").alias("top_cell_type"),
                    L.similarity_class_inclusive(F.col("score")).alias("status")))
    lost = queries.join(stored, LOCUS, "left_anti")
    there = (centroid_matches(lost, centroids, 1)
             .select(*WINDOW_KEY, "end_bp", F.col("score").alias("similarity"),
                     F.lit("NO_REFERENCE_LOCUS").alias("top_sample"), F.lit("UNKNOWN").alias("top_cell_type"),
                     F.lit("NO_REFERENCE").alias("status")))
    return here.unionByName(there)


def cell_type_scores(queries: DataFrame, refs: DataFrame, rows=blocks.ROWS_PER_BLOCK) -> DataFrame:
    """Best score of every query tile against every reference cell type."""
    q = queries.select("sample_id", "id", "chr", "start_bp", "end_bp", "fingerprint")
    r = refs.select("id", "cell_type", "fingerprint")
    return blocks.best_per_label(q, r, "cell_type", q_key=["id"], r_key="id", rows=rows)


def keyed_permutations(n_perm: int, dim: int, seed: int = C.SEED) -> np.ndarray:
    """``n_perm`` permutations of the positions 0..dim-1, each in the order of keyed hashes."""
    def mark(k, i):
        return hashlib.md5(f"{seed}:{k}:{i}".encode()).digest()
    return np.array([sorted(range(dim), key=lambda i: mark(k, i)) for k in range(n_perm)]).reshape(n_perm, dim)


def permutation_pvalues(queries: DataFrame, refs: DataFrame, n_perm: int = C.PERMUTATIONS,
                        seed: int = C.SEED, dim: int = C.FP_DIM) -> DataFrame:
    """Observed mean cosine to the references of the locus, and its permutation p-value.

    The mean over references is linear, so the shuffled vectors are scored
    against one mean reference vector per locus. Shuffle k orders the positions by the md5 of "seed:k:position", so every
    engine and every run draws the same ones. Rows without a usable vector take no part.
    """
    shuffles = keyed_permutations(n_perm, dim, seed)
    mean_ref = (refs.where(V.usable(F.col("fingerprint"))).select(*LOCUS, V.unit(F.col("fingerprint")).alias("u"))
                .groupBy(*LOCUS).agg(V.mean_vectors(F.col("u"), dim).alias("mean_ref")))

    @F.pandas_udf("observed double, p_value double")
    def test(fp: pd.Series, mean: pd.Series) -> pd.DataFrame:
        out = []
        for a in range(0, len(fp), 64):
            q = np.stack(fp.iloc[a:a + 64].values).astype(np.float64)
            m = np.stack(mean.iloc[a:a + 64].values).astype(np.float64)
            q = q / (np.linalg.norm(q, axis=1, keepdims=True) + C.EPS)
            observed = np.einsum("nd,nd->n", q, m)
            null = np.einsum("npd,nd->np", q[:, shuffles], m)
            hits = (null >= observed[:, None]).sum(axis=1)
            out.append(pd.DataFrame({"observed": observed, "p_value": (hits + 1) / (n_perm + 1)}))
        return pd.concat(out, ignore_index=True)

    return (queries.where(V.usable(F.col("fingerprint"))).select(*WINDOW_KEY, "fingerprint").join(mean_ref, LOCUS)
            .withColumn("_t", test("fingerprint", "mean_ref"))
            .select(*WINDOW_KEY, "_t.observed", "_t.p_value"))


def tile_positions(tiles: DataFrame, by="sample_id", listed: bool = False) -> DataFrame:
    """Tiles with their ``position`` (from 1) in their sample, by chromosome name or in the listed chromosome order."""
    from ..functions.names import chromosome_index
    first = [chromosome_index(F.col("chr")).asc_nulls_last()] if listed else []
    order = Window.partitionBy(by).orderBy(*first, "chr", "start_bp")
    return tiles.withColumn("position", F.row_number().over(order))
