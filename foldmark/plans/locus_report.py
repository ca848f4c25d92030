"""The locus-by-locus query: window results and their four levels, in three variants."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import labels as L
from ..functions import vectors as V
from ..operators import annotation
from ..operators import rollups as R
from ..operators import similarity as S
from ..sources.scratch import written


def window_table(queries: DataFrame, refs: DataFrame, k: int = C.TOP_K, ccre: DataFrame | None = None, cell=None,
                 threshold: float = C.CCRE_DELTA) -> DataFrame:
    """Window results with p-value; concordance with the best match where both sides store profiles; with ``ccre`` the annotation.

    ``cell`` maps a sample id column to the sample id used in ``ccre`` (the same one unless given).
    """
    matches = S.locus_matches(queries, refs, k)
    w = S.window_results(queries, matches).join(S.permutation_pvalues(queries, refs), S.WINDOW_KEY, "left")
    w = w.withColumn("locus", L.locus(F.col("chr"), F.col("start_bp"), F.col("end_bp")))
    if all("boundary" in side.columns and "compartment" in side.columns for side in (queries, refs)):
        w = with_concordance(w, queries, refs)
    return w if ccre is None else with_annotation(w, ccre, cell, threshold)


def with_concordance(windows: DataFrame, queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Pearson of boundary and compartment profiles between each window and its best match, null where a profile is missing."""
    own = queries.select(*S.WINDOW_KEY, F.col("boundary").alias("_qb"), F.col("compartment").alias("_qc"))
    theirs = refs.select(F.col("sample_id").alias("top_sample"), "chr", "start_bp",
                         F.col("boundary").alias("_rb"), F.col("compartment").alias("_rc"))
    out = windows.join(own, S.WINDOW_KEY, "left").join(theirs, ["top_sample", "chr", "start_bp"], "left")
    out = (out.withColumn("boundary_concordance", V.concordance(F.col("_qb"), F.col("_rb")))
           .withColumn("compartment_concordance", V.concordance(F.col("_qc"), F.col("_rc")))
           .drop("_qb", "_qc", "_rb", "_rc"))
    return (out.withColumn("boundary_label", L.boundary_concordance_label(F.col("boundary_concordance")))
            .withColumn("compartment_label", L.compartment_concordance_label(F.col("compartment_concordance"))))


def with_annotation(windows: DataFrame, ccre: DataFrame, cell=None, threshold: float = C.CCRE_DELTA) -> DataFrame:
    """``ccre_annot_query`` (16 values) of each window and ``ccre_diff``: a line per category whose count differs by ``threshold`` from the best match's.

    Null for samples without elements; each (cell, locus) is annotated once, whichever side asks.
    """
    cell = cell or (lambda c: c)
    at = ["chr", "start_bp", "end_bp"]
    w = written(windows.withColumn("_own", cell(F.col("sample_id"))).withColumn("_other", cell(F.col("top_sample"))), "windows")
    asked = w.select(F.col("_own").alias("sample_id"), *at).unionByName(w.select(F.col("_other").alias("sample_id"), *at))
    asked = asked.where("sample_id IS NOT NULL").distinct().select(
        "sample_id", F.col("chr").alias("chrom"), F.col("start_bp").alias("win_start"), F.col("end_bp").alias("win_end"))
    known = written(annotation.annotate_windows(asked, ccre).select(
        "sample_id", F.col("chrom").alias("chr"), F.col("win_start").alias("start_bp"), F.col("win_end").alias("end_bp"),
        annotation.annotation_vector().alias("values")), "annotations")
    own = known.select(F.col("sample_id").alias("_own"), *at, F.col("values").alias("ccre_annot_query"))
    other = known.select(F.col("sample_id").alias("_other"), *at, F.col("values").alias("_values"))
    out = w.join(own, ["_own", *at], "left").join(other, ["_other", *at], "left")
    return out.withColumn("ccre_diff", annotation.category_lines(
        F.col("ccre_annot_query"), F.col("_values"), threshold)).drop("_own", "_other", "_values")


def _levels(windows, voted):
    """Level 1 and 2 of every query sample as nested columns."""
    vote = (R.majority_vote(voted).select("sample_id", F.struct(
        F.col("top_cell_type").alias("cell_type"), "votes", "fraction").alias("level1")))
    chroms = (R.chromosome_summary(windows)
              .select("sample_id", F.struct("chr_order", "chr", "mean_similarity", "n_windows", "min_similarity",
                                            "max_similarity", "top_cell_type", "status", "divergent").alias("c"))
              .groupBy("sample_id").agg(F.sort_array(F.collect_list("c")).alias("level2")))
    return vote, chroms


DIVERGENT = ["rank", "locus", "chr", "start_bp", "end_bp", "similarity", "top_sample", "top_cell_type", "status", "p_value"]
OPTIONAL = ["boundary_concordance", "compartment_concordance", "ccre_diff", "ccre_annot_query"]


def four_level_report(queries: DataFrame, refs: DataFrame, k: int = C.TOP_K, n_divergent: int | None = None,
                      ccre: DataFrame | None = None, cell=None) -> DataFrame:
    """One nested row per query sample: vote, chromosome summary, divergent loci.

    Level 1 counts windows with a match; level 2 counts all windows, those
    without a match at score 0. The window map (level 3) is ``window_table``. Divergent loci carry the concordance with
    the best match and, with ``ccre``, the annotation and its changes.
    """
    w = written(window_table(queries, refs, k, ccre, cell), "windows")  # read once per level
    vote, chroms = _levels(w, w.where("has_match"))
    shown = DIVERGENT + [c for c in OPTIONAL if c in w.columns]
    lost = (R.divergent_windows(w, n_divergent).select("sample_id", F.struct(*shown).alias("d"))
            .groupBy("sample_id").agg(F.sort_array(F.collect_list("d")).alias("level4")))
    n = w.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_windows"))
    return n.join(vote, "sample_id", "left").join(chroms, "sample_id").join(lost, "sample_id", "left")


def heldout_report(queries: DataFrame, refs: DataFrame, centroids: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """Held-out variant: windows without reference are reported but take no part in the levels."""
    w = S.heldout_windows(queries, refs, centroids, k)
    valid = w.where("status <> 'NO_REFERENCE'")
    vote, chroms = _levels(valid, valid)
    samples = (R.majority_vote(valid, "top_sample")
               .select("sample_id", F.struct("top_sample", "votes", "fraction").alias("level1_sample")))
    spread = (R.vote_distribution(valid).groupBy("sample_id").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("top_cell_type", "votes")))).alias("vote_distribution")))
    total = w.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_windows_total"))
    return (total.join(vote, "sample_id", "left").join(samples, "sample_id", "left")
            .join(spread, "sample_id", "left").join(chroms, "sample_id", "left")
            .join(R.status_summary(w), "sample_id", "left"))
