"""Roll-ups of window results: votes, chromosome summary, divergent loci, status.

Ties follow one rule everywhere: higher count or score first, then the
alphabetically smaller key.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import labels as L
from ..functions.names import chromosome_order


def vote_distribution(windows: DataFrame, candidate: str = "top_cell_type", by: str = "sample_id") -> DataFrame:
    """Votes per candidate and their share of the windows that voted."""
    votes = windows.groupBy(by, candidate).agg(F.count(F.lit(1)).alias("votes"))
    total = Window.partitionBy(by)
    ranked = Window.partitionBy(by).orderBy(F.desc("votes"), F.asc(candidate))
    return (votes.withColumn("fraction", F.col("votes") * F.lit(1.0) / F.sum("votes").over(total))
            .withColumn("rank", F.row_number().over(ranked)))


def majority_vote(windows: DataFrame, candidate: str = "top_cell_type", by: str = "sample_id") -> DataFrame:
    """Winner per query sample with its votes and share."""
    return vote_distribution(windows, candidate, by).where("rank = 1").drop("rank")


def chromosome_summary(windows: DataFrame, by: str = "sample_id") -> DataFrame:
    """Mean, range, modal cell type and status per query sample and chromosome."""
    per_type = windows.groupBy(by, "chr", "top_cell_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("similarity").alias("s"),
        F.min("similarity").alias("lo"), F.max("similarity").alias("hi"))
    modal = F.min(F.struct((-F.col("n")).alias("neg"), F.col("top_cell_type").alias("ct")))["ct"]
    out = per_type.groupBy(by, "chr").agg(
        (F.sum("s") / F.sum("n")).alias("mean_similarity"), F.sum("n").alias("n_windows"),
        F.min("lo").alias("min_similarity"), F.max("hi").alias("max_similarity"), modal.alias("top_cell_type"))
    return (out.withColumn("divergent", L.is_divergent(F.col("mean_similarity")))
            .withColumn("status", L.chromosome_status(F.col("mean_similarity")))
            .withColumn("chr_order", chromosome_order(F.col("chr"))))


def divergent_windows(windows: DataFrame, limit: int | None = None, by: str = "sample_id",
                      threshold: float = C.SIM_MED) -> DataFrame:
    """Windows below the threshold, most divergent first; ``limit`` is the report size."""
    order = Window.partitionBy(by).orderBy(F.asc("similarity"), F.asc("chr"), F.asc("start_bp"))
    out = windows.where(F.col("similarity") < threshold).withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.where(F.col("rank") <= limit)


def status_summary(windows: DataFrame, by: str = "sample_id") -> DataFrame:
    """Counts per status and mean similarity; windows without reference are left out."""
    def n(status):
        return F.count_if(F.col("status") == status)
    return (windows.where(F.col("status") != "NO_REFERENCE").groupBy(by).agg(
        n("STRUCTURALLY_DIFFERENT").alias("n_divergent"), n("PARTIALLY_SIMILAR").alias("n_partial"),
        n("STRUCTURALLY_SIMILAR").alias("n_similar"), F.avg("similarity").alias("mean_similarity"),
        F.count(F.lit(1)).alias("n_windows")))


def chromosome_locus_rollup(windows: DataFrame, by: str = "sample_id") -> DataFrame:
    """Levels 1 to 3 as one ROLLUP: sample, chromosome, locus."""
    return (windows.rollup(by, "chr", "start_bp").agg(
        F.avg("similarity").alias("mean_similarity"), F.count(F.lit(1)).alias("n_windows"),
        F.grouping_id().alias("level")).where(F.col(by).isNotNull()))


def cell_type_similarity(scores: DataFrame, by: str = "sample_id") -> DataFrame:
    """Mean over query tiles of the best score per cell type, with loci won and rank."""
    best = F.min(F.struct((-F.col("score")).alias("neg"), F.col("ref_key"), F.col("cell_type")))
    won = (scores.groupBy(by, "id").agg(best["cell_type"].alias("cell_type"))
           .groupBy(by, "cell_type").agg(F.count(F.lit(1)).alias("loci_won")))
    mean = scores.groupBy(by, "cell_type").agg(F.avg("score").alias("similarity"), F.count(F.lit(1)).alias("n_tiles"))
    order = Window.partitionBy(by).orderBy(F.desc("similarity"), F.asc("cell_type"))
    return (mean.join(won, [by, "cell_type"], "left").na.fill(0, ["loci_won"])
            .withColumn("rank", F.row_number().over(order)))


def divergent_by_zscore(best: DataFrame, n: int | None = None, by: str | None = "sample_id") -> DataFrame:
    """Best scores with a z-score (population std + 1e-8), per sample (ranked) or of the whole table; the n lowest if asked."""
    both = [F.avg("score").alias("_m"), (F.stddev_pop("score") + C.EPS).alias("_s")]
    if by is None:
        lowest = best if n is None else best.orderBy(F.asc("score"), F.asc("id")).limit(n)
        z = lowest.withColumn("_st", best.agg(*both).select(F.struct("_m", "_s")).scalar())
        return (z.withColumn("z_score", (F.col("score") - F.col("_st._m")) / F.col("_st._s")).drop("_st")
                .withColumn("locus", L.locus_mb(F.col("chr"), F.col("start_bp"), F.col("end_bp"))))
    stats = best.groupBy(by).agg(*both)
    order = Window.partitionBy(by).orderBy(F.asc("score"), F.asc("id"))
    lowest = best.withColumn("rank", F.row_number().over(order))
    if n is not None:
        lowest = lowest.where(F.col("rank") <= n)
    return (lowest.join(stats, by)
            .withColumn("z_score", (F.col("score") - F.col("_m")) / F.col("_s")).drop("_m", "_s")
            .withColumn("locus", L.locus_mb(F.col("chr"), F.col("start_bp"), F.col("end_bp"))))
