"""Sample-name columns: canonical cell name, accession strip, replicate group."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _trim_edges(name):
    return F.regexp_replace(name, C.EDGE_PATTERN, "")


def strip_accession(stem: Column) -> Column:
    """File stem without its archive accession."""
    return _trim_edges(F.regexp_replace(stem, C.ACCESSION_PATTERN, ""))


def sample_name(stem: Column) -> Column:
    """Registry id of a file: accession removed, whole stem if nothing is left."""
    return F.coalesce(F.nullif(strip_accession(stem), F.lit("")), stem)


def cell_name(stem: Column) -> Column:
    """Canonical cell-line name: accession, then replicate or condition, removed."""
    short = _trim_edges(F.regexp_replace(strip_accession(stem), C.CONDITION_PATTERN, ""))
    return F.coalesce(F.nullif(short, F.lit("")), stem)


def replicate_group(sample_id: Column) -> Column:
    """Biological group of a sample id (case-sensitive replicate suffix removed)."""
    return F.regexp_replace(sample_id, C.REPLICATE_PATTERN, "")


def file_stem(path: Column, extension: str) -> Column:
    """Last path component without the given extension."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(base, extension.replace(".", r"\.") + "$", "")


def chromosome_order(chrom: Column) -> Column:
    """Numeric sort key of a chromosome; names without a number sort last."""
    return F.coalesce(F.substring(chrom, 4, 99).try_cast("int"), F.lit(999))


def chromosome_index(chrom: Column) -> Column:
    """Position in the fixed chromosome list, NULL when not in it."""
    listed = F.array(*[F.lit(c) for c in C.CHROMOSOMES])
    return F.nullif(F.array_position(listed, chrom), F.lit(0))


def assay_code(assay: Column) -> Column:
    """Integer code of an assay name, 0 for unknown names."""
    codes = F.create_map(*[F.lit(x) for kv in C.ASSAY_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, assay), F.lit(0))
