"""Explicit schemas of the stored tables and text inputs."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType,
    StringType, StructField, StructType,
)


def _struct(*fields):
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


_VECTOR = ArrayType(FloatType())

SAMPLES = _struct(
    ("sample_id", StringType(), False),
    ("cell_type", StringType(), False),
    ("tissue", StringType(), True),
    ("assay_type", StringType(), False),
    ("source", StringType(), True),
    ("n_tiles", IntegerType(), True),
)

FINGERPRINTS = _struct(
    ("id", LongType(), False),
    ("sample_id", StringType(), False),
    ("chr", StringType(), False),
    ("start_bp", LongType(), False),
    ("end_bp", LongType(), False),
    ("fingerprint", _VECTOR, False),
    ("boundary", _VECTOR, True),
    ("compartment", _VECTOR, True),
    ("ccre_annot", _VECTOR, True),
)

HISTOGRAMS = _struct(
    ("sample_id", StringType(), False),
    ("code_histogram", _VECTOR, False),
)

CENTROIDS = _struct(
    ("chr", StringType(), False),
    ("start_bp", LongType(), False),
    ("end_bp", LongType(), False),
    ("centroid", _VECTOR, False),
    ("n_samples", IntegerType(), True),
)

CENTROID_INDEX = _struct(
    ("chr", StringType(), False),
    ("start_bp", LongType(), False),
    ("end_bp", LongType(), False),
    ("vector", _VECTOR, False),
)

TILES = _struct(
    ("sample_id", StringType(), False),
    ("cell_line_name", StringType(), True),
    ("cell_line_idx", IntegerType(), True),
    ("chr", StringType(), False),
    ("start_bin", LongType(), False),
    ("end_bin", LongType(), False),
    ("start_bp", LongType(), False),
    ("end_bp", LongType(), False),
    ("matrix", _VECTOR, False),
)

PIXELS = _struct(
    ("sample_id", StringType(), False),
    ("chrom", StringType(), False),
    ("bin1", LongType(), False),
    ("bin2", LongType(), False),
    ("cnt", DoubleType(), False),
)

BINS = _struct(
    ("sample_id", StringType(), False),
    ("chrom", StringType(), False),
    ("bin", LongType(), False),
    ("weight", DoubleType(), True),
)

BIN_QUALITY = _struct(
    ("chrom", StringType(), False),
    ("bin", LongType(), False),
    ("valid", BooleanType(), False),
)

CYTOBAND = _struct(
    ("chrom", StringType(), True),
    ("start_bp", LongType(), True),
    ("end_bp", LongType(), True),
    ("name", StringType(), True),
    ("giestain", StringType(), True),
)

GENES = _struct(
    ("chrom", StringType(), False),
    ("start_bp", LongType(), False),
    ("end_bp", LongType(), False),
    ("strand", StringType(), True),
    ("gene_id", StringType(), True),
    ("gene_name", StringType(), True),
    ("gene_type", StringType(), True),
    ("cancer_role", StringType(), True),
)

REGISTRY = _struct(
    ("sample_id", StringType(), False),
    ("file", StringType(), True),
    ("assay", StringType(), True),
    ("tissue", StringType(), True),
)

# text inputs: every column as text, converted after the malformed rows are gone
BED_TEXT = _struct(*[(f"c{i}", StringType(), True) for i in range(10)])
GTF_TEXT = _struct(*[
    (n, StringType(), True)
    for n in ("chrom", "source", "feature", "start", "end", "score", "strand", "frame", "attrs")
])
