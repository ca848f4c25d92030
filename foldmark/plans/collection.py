"""Whole-collection pipelines: query, two-sample comparison, accuracy test, catalogue."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..functions import names as N
from ..functions import vectors as V
from ..operators import annotation, blocks, rollups
from ..operators import similarity as S
from ..sources.scratch import written

_TILE = ["id", "chr", "start_bp", "end_bp", "fingerprint"]


def reference_set(fingerprints: DataFrame) -> DataFrame:
    """Reference vectors labelled with the canonical cell name."""
    return fingerprints.withColumn("cell_type", N.cell_name(F.col("sample_id")))


def divergent_from_top(queries: DataFrame, refs: DataFrame, n: int | None = None) -> DataFrame:
    """Loci where each query sample is least like its best matching cell type."""
    scores = S.cell_type_scores(queries, refs)
    return _divergent(scores, rollups.cell_type_similarity(scores), n)


def _divergent(scores, ranking, n):
    top = ranking.where("rank = 1").select("sample_id", "cell_type")
    return rollups.divergent_by_zscore(scores.join(top, ["sample_id", "cell_type"]), n)


def query_report(queries: DataFrame, refs: DataFrame, n_types: int | None = None, n_loci: int | None = None,
                 ccre: DataFrame | None = None, cell=N.cell_name) -> DataFrame:
    """One row per query sample: ranked cell types, loci from the most divergent on, summary and, with ``ccre``, element counts.

    All cell types and loci, unless the caller asks for the first few. ``regulatory`` compares the elements of the query's cell (``cell`` of
    its sample id) with those of the first-ranked cell type, category by category; it is null where one has no elements.
    """
    scores = written(S.cell_type_scores(queries, refs), "type-scores")  # one row per tile and cell type, read several times
    ranking = written(rollups.cell_type_similarity(scores), "type-ranking")
    own = cell(F.col("sample_id"))
    matches = ranking.select("sample_id", "n_tiles", F.struct(
        "rank", "cell_type", "similarity", L.confidence_badge(F.col("similarity")).alias("confidence"),
        L.bar(F.col("similarity"), 16).alias("visual"), "loci_won", L.same_name(F.col("cell_type"), own).alias("same")).alias("m"))
    types = (matches.groupBy("sample_id").agg(F.max("n_tiles").alias("n_tiles"), F.sort_array(F.collect_list("m")).alias("m")))
    first = F.col("m")[0]
    three = F.slice("m", 1, 3)
    n_refs = refs.agg(F.count_distinct("cell_type").alias("n")).scalar()
    summary = F.struct(
        first["cell_type"].alias("top_match"), first["similarity"].alias("top_similarity"), first["confidence"].alias("confidence"),
        (F.aggregate(three, F.lit(0.0), lambda s, x: s + x["similarity"]) / F.size(three)).alias("mean_of_three"),
        n_refs.alias("n_reference"))
    shown = F.col("m") if n_types is None else F.slice("m", 1, n_types)
    types = types.select("sample_id", "n_tiles", shown.alias("top_matches"), summary.alias("summary"))
    loci = (_divergent(scores, ranking, n_loci)
            .select("sample_id", F.struct("rank", "locus", "chr", "start_bp", "end_bp",
                                          F.col("score").alias("similarity"), "z_score").alias("d"))
            .groupBy("sample_id").agg(F.sort_array(F.collect_list("d")).alias("divergent_loci")))
    out = types.join(loci, "sample_id", "left")
    if ccre is None:
        return out
    pairs = ranking.where("rank = 1").select("sample_id", own.alias("own"), F.col("cell_type").alias("other"))
    return out.join(_regulatory(pairs, ccre), "sample_id", "left")


def _regulatory(pairs: DataFrame, ccre: DataFrame) -> DataFrame:
    """``regulatory`` per (sample_id, own, other): counts by category of both, rows empty in both left out."""
    n = annotation.profile_counts(ccre)
    own = n.select(F.col("sample_id").alias("own"), "category_no", "category", F.col("n").alias("n_query"))
    other = n.select(F.col("sample_id").alias("other"), "category_no", F.col("n").alias("n_ref"))
    met = pairs.join(own, "own").join(other, ["other", "category_no"]).where("n_query > 0 OR n_ref > 0")
    line = F.struct("category_no", "category", "n_query", "n_ref", L.change_arrow(F.col("n_query") - F.col("n_ref")).alias("difference"))
    return met.groupBy("sample_id").agg(F.sort_array(F.collect_list(line)).alias("regulatory"))


def _best_of_b(a: DataFrame, b: DataFrame) -> DataFrame:
    return blocks.top_matches(a.select(*_TILE), b.select("id", "fingerprint"), 1, q_key=["id"], r_key="id")


def compare_samples(a: DataFrame, b: DataFrame, high: float = 0.85, dim: int = 64) -> DataFrame:
    """Mean and largest cosine between the tiles of two samples, and the share of well-matched tiles.

    The mean over all pairs is the dot product of the two mean unit vectors.
    """
    return _compared(_best_of_b(a, b), a, b, high, dim)


def _compared(best, a, b, high=0.85, dim=64):
    best = best.agg(F.max("score").alias("max_similarity"), F.avg((F.col("score") > high).cast("double")).alias("fraction_high"))

    def units(side, mark):
        return side.where(V.usable(F.col("fingerprint"))).select(F.lit(mark).alias("_s"), V.unit(F.col("fingerprint")).alias("u"))

    def centre(side):
        return V.mean_vectors(F.when(F.col("_s") == side, F.col("u")), dim)

    mean = (units(a, "a").unionByName(units(b, "b")).agg(centre("a").alias("_a"), centre("b").alias("_b"))
            .select(V.dot(F.col("_a"), F.col("_b"))))
    return (best.withColumn("mean_similarity", mean.scalar())
            .withColumn("verdict", L.pair_verdict(F.col("mean_similarity"))))


def compare_by_chromosome(a: DataFrame, b: DataFrame) -> DataFrame:
    return _by_chromosome(_best_of_b(a, b))


def _by_chromosome(best):
    return (best.groupBy("chr").agg(F.avg("score").alias("mean_similarity"), F.count(F.lit(1)).alias("n_tiles"))
            .withColumn("visual", L.bar(F.col("mean_similarity"), 12)))


def compare_divergent(a: DataFrame, b: DataFrame, n: int | None = None) -> DataFrame:
    """Tiles of A with the z-score of their best match in B; the n least alike if asked."""
    return rollups.divergent_by_zscore(_best_of_b(a, b).drop("rank"), n, by=None)


def compare_report(a: DataFrame, b: DataFrame, ccre: DataFrame | None = None, cell_a: str | None = None, cell_b: str | None = None,
                   n_loci: int | None = None) -> DataFrame:
    """The whole comparison of two samples as one nested row.

    Similarity with verdict and texts, ``by_chromosome`` in the listed order, ``divergent_loci`` from the least alike on and, with ``ccre``,
    ``regulatory`` by category with both totals. The best matches are worked out once.
    """
    best = written(_best_of_b(a, b), "compare")
    one = _compared(best, a, b)
    mean, high = F.col("mean_similarity"), F.col("fraction_high")
    one = one.select("*", L.bar(mean).alias("visual"), L.confidence_badge(mean).alias("confidence"), L.bar(high).alias("visual_high"))
    listed = F.struct(N.chromosome_order(F.col("chr")).alias("chr_order"), "chr", "mean_similarity", "n_tiles", "visual")
    chroms = _by_chromosome(best).agg(F.sort_array(F.collect_list(listed)).alias("v"))
    loci = rollups.divergent_by_zscore(best.drop("rank"), n_loci, by=None)
    least = F.sort_array(F.collect_list(F.struct("score", "id", "locus", "chr", "start_bp", "end_bp", "z_score")))
    loci = loci.agg(F.transform(least, lambda x, i: F.struct(
        (i + 1).alias("rank"), x["locus"].alias("locus"), x["chr"].alias("chr"), x["start_bp"].alias("start_bp"), x["end_bp"].alias("end_bp"),
        x["score"].alias("similarity"), x["z_score"].alias("z_score"))).alias("v"))
    out = one.withColumn("by_chromosome", chroms.scalar()).withColumn("divergent_loci", loci.scalar())
    if ccre is None:
        return out
    pair = ccre.sparkSession.range(1).select(F.lit("a").alias("sample_id"), F.lit(cell_a).alias("own"), F.lit(cell_b).alias("other"))
    lines = _regulatory(pair, ccre).agg(F.first("regulatory").alias("v"))
    total = lambda c: F.aggregate("regulatory", F.lit(0).cast("long"), lambda s, x: s + x[c])
    return (out.withColumn("regulatory", lines.scalar())
            .withColumn("total_a", total("n_query")).withColumn("total_b", total("n_ref")))


def accuracy_test(queries: DataFrame, refs: DataFrame, truth: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Share of query samples whose first-ranked cell type is the true one.

    ``truth`` has sample_id and true_type; samples without tiles count as wrong.
    """
    wanted = truth.join(queries.select("sample_id").distinct(), "sample_id", "left_semi")
    return score_predictions(rollups.cell_type_similarity(S.cell_type_scores(queries, refs)), wanted, threshold)


def score_predictions(ranking: DataFrame, truth: DataFrame, threshold: float = 0.7) -> DataFrame:
    first = ranking.where("rank = 1").select("sample_id", F.col("cell_type").alias("predicted"))
    hit = F.coalesce(L.same_name(F.col("predicted"), F.col("true_type")), F.lit(False))
    return (truth.join(first, "sample_id", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("correct"),
        F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("accuracy"))
        .withColumn("passed", F.col("accuracy") > threshold))


def catalogue(sample_files: DataFrame, annotation_files: DataFrame, extension: str = ".mcool") -> DataFrame:
    """Cells with file count, total size in GB and whether an annotation exists."""
    cells = (sample_files.withColumn("cell", N.cell_name(N.file_stem(F.col("path"), extension)))
             .groupBy("cell").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes")))
    match = annotation.match_annotation_files(cells.select("cell"), annotation_files)
    return (cells.join(match, "cell", "left")
            .select("cell", "n_files", (F.col("bytes") / 1e9).alias("total_gb"),
                    F.col("annotation_path").isNotNull().alias("has_annotation")))


def pair_regulatory_report(ccre: DataFrame, cell_a: str, cell_b: str) -> DataFrame:
    """Category counts of two cells and their signed difference; rows empty in both are hidden."""
    return (annotation.compare_profiles(ccre, cell_a, cell_b).where("n_a > 0 OR n_b > 0")
            .withColumn("difference", L.change_arrow(F.col("diff"))))


def first_files(sample_files: DataFrame, extension: str = ".mcool") -> DataFrame:
    """First file in path order of every cell."""
    named = sample_files.withColumn("cell", N.cell_name(N.file_stem(F.col("path"), extension)))
    order = Window.partitionBy("cell").orderBy("path")
    return named.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
