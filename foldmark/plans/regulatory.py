"""Regulatory and gene context of divergent windows; registry report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import annotation as A
from ..operators import replicates as R


def divergent_context(divergent: DataFrame, ccre: DataFrame, genes: DataFrame, max_dist: int = 500_000) -> DataFrame:
    """Elements inside each divergent window with their nearest gene.

    ``divergent`` has sample_id, chr, start_bp, end_bp.
    """
    w = divergent.select("sample_id", F.col("chr").alias("chrom"), F.col("start_bp").alias("win_start"),
                         F.col("end_bp").alias("win_end")).distinct()
    return A.annotate_elements(A.element_coordinates(w, ccre), A.with_roles(genes), max_dist)


def differential_report(windows: DataFrame, ccre: DataFrame, query: str, ref: str,
                        threshold: float = C.CCRE_DELTA) -> DataFrame:
    """Report lines of the regulatory change between two samples at every window."""
    return A.differential_lines(A.differential(A.annotate_windows(windows, ccre), query, ref), threshold)


def structure_context(boundaries: DataFrame, switches: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gene context of lost boundaries and of compartment switches."""
    g = A.with_roles(genes)
    return A.boundary_losses(boundaries, g), A.compartment_switches(switches, g)


def registry_report(registry: DataFrame, contact_files: DataFrame, annotations: DataFrame,
                    annotation_files: DataFrame, directory: str = "") -> tuple[DataFrame, DataFrame]:
    """Validated registry rows and the one-row summary."""
    v = R.validate_registry(registry, contact_files, annotations, annotation_files, directory)
    return v, R.registry_summary(v)
