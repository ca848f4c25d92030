"""File listings and text readers, always with an explicit schema."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from .. import schema as T
from ..functions import genes as G
from ..functions import names as N


def listing(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """path and length of the matching files; file contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
            .select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length"))


def sample_registry(files: DataFrame, extension: str = ".mcool") -> DataFrame:
    """Registry from contact files; of two files with one clean name the later path wins."""
    named = files.select("path", N.sample_name(N.file_stem(F.col("path"), extension)).alias("sample_id"))
    last = Window.partitionBy("sample_id").orderBy(F.desc("path"))
    return (named.withColumn("_n", F.row_number().over(last)).where("_n = 1")
            .select("sample_id", F.element_at(F.split("path", "/"), -1).alias("file"),
                    F.lit("bulk_hic").alias("assay"), F.lit("unknown").alias("tissue")))


def registry_or_fallback(files: DataFrame) -> DataFrame:
    """Discovered registry, or the fixed entries when there are no files at all."""
    found = sample_registry(files)
    fixed = found.sparkSession.createDataFrame(C.FALLBACK_SAMPLES, T.REGISTRY)
    none = found.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar() == 0
    return found.unionByName(fixed.where(none))


def group_files(files: DataFrame, extension: str = ".mcool") -> DataFrame:
    """Paths of every canonical cell name, in path order."""
    return (files.withColumn("cell", N.cell_name(N.file_stem(F.col("path"), extension)))
            .groupBy("cell").agg(F.sort_array(F.collect_list("path")).alias("paths")))


def annotation_files(files: DataFrame, extension: str = ".bed.gz") -> DataFrame:
    """Annotation path by accession-stripped name; of equal names the later path wins."""
    return (files.select(N.strip_accession(N.file_stem(F.col("path"), extension)).alias("key"), "path")
            .groupBy("key").agg(F.max("path").alias("path")))


def read_ccre(spark: SparkSession, paths, chromosomes_only: bool = False, with_name: bool = False) -> DataFrame:
    """Regulatory elements of BED files (gzip or not): chrom, start, end, category, source path and, if asked, the name column.

    Rows of fewer than ten columns are dropped; unknown categories become the
    background category.
    """
    raw = (spark.read.schema(T.BED_TEXT).option("sep", "\t").option("comment", "#").option("quote", "")
           .option("mode", "PERMISSIVE").csv(paths))
    c = F.trim("c9")
    out = raw.where(F.col("c9").isNotNull()).select(
        F.col("c0").alias("chrom"), F.col("c1").cast("long").alias("start_bp"), F.col("c2").cast("long").alias("end_bp"),
        F.when(c.isin(C.CCRE_CATEGORIES), c).otherwise(C.CCRE_DEFAULT).alias("category"),
        F.regexp_replace(F.input_file_name(), "^file:/*", "/").alias("path"), *([F.col("c3").alias("name")] if with_name else []))
    return out.where(F.col("chrom").isin(C.CHROMOSOMES)) if chromosomes_only else out


def _attribute(key):
    return F.nullif(F.regexp_extract("attrs", key + r'\s+"([^"]+)"', 1), F.lit(""))


def read_genes(spark: SparkSession, path) -> DataFrame:
    """Genes of a GTF file (gzip or not): 0-based start, attributes, role; first row of a gene id wins.

    A row's place is its file, the start of its file block and its order inside
    the block.
    """
    raw = (spark.read.schema(T.GTF_TEXT).option("sep", "\t").option("comment", "#").option("quote", "").csv(path))
    g = raw.where((F.col("feature") == "gene") & F.col("attrs").isNotNull()).select(
        "chrom", (F.col("start").cast("long") - 1).alias("start_bp"), F.col("end").cast("long").alias("end_bp"), "strand",
        _attribute("gene_id").alias("gene_id"), _attribute("gene_name").alias("_name"),
        _attribute("gene_type").alias("_type"), F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id().alias("row")).alias("_at"))
    first = Window.partitionBy("gene_id").orderBy("_at")
    return (g.withColumn("_n", F.row_number().over(first)).where("_n = 1")
            .withColumn("gene_name", F.coalesce("_name", "gene_id"))
            .withColumn("gene_type", F.coalesce("_type", F.lit("unknown")))
            .withColumn("cancer_role", G.cancer_role(F.col("gene_name")))
            .select(*T.GENES.names))


def fallback_genes(spark: SparkSession) -> DataFrame:
    """The fixed gene table of two chromosomes, used without an annotation file."""
    rows = spark.createDataFrame(C.FALLBACK_GENES, "chrom string, start_bp long, end_bp long, gene_name string")
    return (rows.withColumn("strand", F.lit("+")).withColumn("gene_id", F.col("gene_name"))
            .withColumn("gene_type", F.lit("protein_coding"))
            .withColumn("cancer_role", G.cancer_role(F.col("gene_name"))).select(*T.GENES.names))


def read_cytoband(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(T.CYTOBAND).option("sep", "\t").csv(path)


def read_pixels(spark: SparkSession, path) -> DataFrame:
    """Contact pixels dumped as parquet."""
    return spark.read.schema(T.PIXELS).parquet(path)


def read_bins(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(T.BINS).parquet(path)


def curated_genes(spark: SparkSession) -> DataFrame:
    """Distinct names of the oncogene, suppressor and chromatin sets (the cancer genes)."""
    parts = [C.ONCOGENES, C.TUMOR_SUPPRESSORS, C.CHROMATIN_REGULATORS]
    dfs = [spark.createDataFrame([(g,) for g in p], "gene_name string") for p in parts]
    return dfs[0].union(dfs[1]).union(dfs[2]).distinct()
