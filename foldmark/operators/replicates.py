"""Replicate groups: matching, consistency, registry validation."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import labels as L
from ..functions import names as N
from . import blocks


def with_group(df: DataFrame, sample: str = "sample_id") -> DataFrame:
    return df.withColumn("grp", N.replicate_group(F.col(sample)))


def group_members(samples: DataFrame) -> DataFrame:
    """Member list and size of every replicate group."""
    return (with_group(samples.select("sample_id")).groupBy("grp")
            .agg(F.sort_array(F.collect_list("sample_id")).alias("members"), F.count(F.lit(1)).alias("n_members")))


def largest_groups(samples: DataFrame, cell: str, n: int | None = None) -> DataFrame:
    """Cells with more than one file, most files first; the first n if asked."""
    groups = (samples.groupBy(cell).agg(F.count(F.lit(1)).alias("n_files")).where("n_files > 1")
              .orderBy(F.desc("n_files"), F.asc(cell)))
    return groups if n is None else groups.limit(n)


def group_matches(matches: DataFrame, by, sample: str = "match_sample") -> DataFrame:
    """Matches with the mean, spread, size and confidence of their replicate group."""
    w = Window.partitionBy(*by, "grp")
    m = with_group(matches, sample)
    n, std = F.count(F.lit(1)).over(w), F.stddev_pop("score").over(w)
    return (m.withColumn("n_replicates", n).withColumn("_std", std)
            .withColumn("group_sim_mean", F.round(F.avg("score").over(w), 4))
            .withColumn("group_sim_std", F.round("_std", 4))
            .withColumn("confidence", F.when(F.col("n_replicates") > 1, L.spread_confidence(F.col("_std")))
                        .otherwise("single_sample")).drop("_std"))


def best_group(matches: DataFrame, by, sample: str = "match_sample") -> DataFrame:
    """Group with the highest mean score per query; one replicate counts as high confidence."""
    per = with_group(matches, sample).groupBy(*by, "grp").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("mean"), F.asc("grp"))
    return (per.withColumn("_r", F.row_number().over(order)).where("_r = 1")
            .select(*by, "grp", F.round("mean", 4).alias("mean_similarity"),
                    F.when(F.col("n") == 1, "high").otherwise(L.spread_confidence(F.col("std"))).alias("confidence")))


def replicate_consistency(fingerprints: DataFrame, rows: int = blocks.ROWS_PER_BLOCK) -> DataFrame:
    """Mean and spread over replicate pairs of their mean cosine at shared loci.

    Samples, not rows, are hashed to blocks, so a block pair holds all loci of its sample
    pairs (bounded by the genome) and writes the number, sum and sum of squares of their similarities.
    """
    locus = F.concat_ws(":", "chr", F.col("start_bp").cast("string")).alias("locus")
    side = with_group(fingerprints).select("grp", locus, "sample_id", "fingerprint")
    schema = StructType([StructField("grp", StringType()), StructField("n", LongType()),
                         StructField("total", DoubleType()), StructField("squares", DoubleType())])

    def kernel(qt, rt):
        def index(t):
            names, at = np.unique(blocks.column_values(t, "sample_id"), return_inverse=True)
            return names, at, blocks.matrix_of(t, "fingerprint", C.EPS)
        an, ai, av = index(qt)
        bn, bi, bv = index(rt)
        loci, place = np.unique(np.concatenate([blocks.column_values(qt, "locus"), blocks.column_values(rt, "locus")]),
                                return_inverse=True)
        a_rows, b_rows = (np.argsort(x, kind="stable") for x in (place[:len(ai)], place[len(ai):]))
        a_cut, b_cut = (np.searchsorted(np.sort(x), np.arange(len(loci) + 1)) for x in (place[:len(ai)], place[len(ai):]))
        total, n = np.zeros((len(an), len(bn))), np.zeros((len(an), len(bn)), dtype=np.int64)
        for k in range(len(loci)):
            x, y = a_rows[a_cut[k]:a_cut[k + 1]], b_rows[b_cut[k]:b_cut[k + 1]]
            if len(x) and len(y):
                cells = np.ix_(ai[x], bi[y])
                total[cells] += av[x] @ bv[y].T
                n[cells] += 1
        pair = (n > 0) & (an[:, None] < bn[None, :])
        sim = total[pair] / n[pair]
        return pa.table({"grp": [qt.column("grp")[0].as_py()], "n": [len(sim)], "total": [float(sim.sum())],
                         "squares": [float((sim * sim).sum())]})

    parts = blocks.block_pairs(blocks.with_vector(side, "fingerprint"), blocks.with_vector(side, "fingerprint"), kernel, schema,
                               keys=["grp"], q_block="sample_id", r_block="sample_id", rows=rows)
    mean = F.sum("total") / F.sum("n")
    stats = (parts.where("n > 0").groupBy("grp").agg(mean.alias("mean"), (F.sum("squares") / F.sum("n")).alias("_m2"))
             .withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("_m2") - F.col("mean") * F.col("mean")))))
    size = side.groupBy("grp").agg(F.count_distinct("sample_id").alias("n_replicates"))
    alone = F.col("mean").isNull()
    return size.join(stats, "grp", "left").select(
        "grp", "n_replicates",
        F.when(alone, 1.0).otherwise(F.round("mean", 4)).alias("mean_cosine_similarity"),
        F.when(alone, 0.0).otherwise(F.round("std", 4)).alias("std_cosine_similarity"),
        F.when(alone, "single_sample").otherwise(L.replicate_confidence(F.col("mean"))).alias("confidence"))


def validate_registry(registry: DataFrame, contact_files: DataFrame, annotations: DataFrame,
                      annotation_files: DataFrame, directory: str = "") -> DataFrame:
    """Registry rows with resolved paths, existence flags, group, mode, skip and warnings.

    ``contact_files`` and ``annotation_files`` list existing paths (``path``);
    ``annotations`` maps sample or group to a path.
    """
    r = with_group(registry)
    absolute = F.col("file").startswith("/")
    r = r.withColumn("contact_path", F.when(absolute | F.lit(directory == ""), F.col("file")).otherwise(
        F.concat(F.lit(directory.rstrip("/") + "/"), F.col("file"))))
    have_c = contact_files.select(F.col("path").alias("contact_path")).distinct().withColumn("contact_exists", F.lit(True))
    have_a = annotation_files.select(F.col("path").alias("annotation_path")).distinct().withColumn(
        "annotation_exists", F.lit(True))
    own = annotations.select("sample_id", F.col("path").alias("_own"))
    shared = annotations.select(F.col("sample_id").alias("grp"), F.col("path").alias("_shared"))
    out = (r.join(have_c, "contact_path", "left").join(own, "sample_id", "left").join(shared, "grp", "left")
           .withColumn("annotation_path", F.coalesce("_own", "_shared")).drop("_own", "_shared")
           .join(have_a, "annotation_path", "left").na.fill(False, ["contact_exists", "annotation_exists"]))
    # fixed texts
    off = "  — regulatory analysis DISABLED"
    warn = F.array_compact(F.array(
        F.when(~F.col("contact_exists"), F.concat(F.lit("contact file not found: "), F.col("contact_path"),
                                                  F.lit("  — sample will be SKIPPED"))),
        F.when(~F.col("annotation_exists") & F.col("annotation_path").isNotNull(),
               F.concat(F.lit("cCRE file not found: "), F.col("annotation_path"), F.lit(off))),
        F.when(F.col("annotation_path").isNull(), F.concat(
            F.lit("No cCRE annotation registered for "), F.col("sample_id"), F.lit("  (group: "), F.col("grp"),
            F.lit(")" + off)))))
    return (out.withColumn("skip", ~F.col("contact_exists"))
            .withColumn("mode", F.when(F.col("annotation_exists"), "full").otherwise("structural_only"))
            .withColumn("warnings", warn))


def registry_summary(validated: DataFrame) -> DataFrame:
    ok = ~F.col("skip")
    return validated.agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_distinct("grp").alias("n_groups"),
        F.count_if(ok & (F.col("mode") == "full")).alias("n_full"),
        F.count_if(ok & (F.col("mode") == "structural_only")).alias("n_structural_only"),
        F.count_if("skip").alias("n_skipped"))


def active_samples(validated: DataFrame) -> DataFrame:
    return validated.where(~F.col("skip"))


def usable_annotations(validated: DataFrame) -> DataFrame:
    """Annotation registry of the samples that are kept and have a file."""
    return (validated.where(F.col("annotation_exists") & ~F.col("skip"))
            .select("sample_id", F.col("annotation_path").alias("path")))


def wanted_samples(samples: DataFrame, names: DataFrame, cell: str = "cell_line_name") -> DataFrame:
    """Samples whose id or canonical name is in ``names``."""
    by_id = samples.join(names.select(F.col("name").alias("sample_id")), "sample_id", "left_semi")
    by_cell = samples.join(names.select(F.col("name").alias(cell)), cell, "left_semi")
    return by_id.unionByName(by_cell.select(*by_id.columns)).dropDuplicates(["sample_id"])
