"""Regulatory-element and gene annotation of genome windows."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import genes as G
from ..functions import names as N
from . import blocks
from . import intervals as I

WINDOW = ["sample_id", "chrom", "win_start", "win_end"]


# ---- regulatory elements ---------------------------------------------------

def clean_category(category):
    """Trimmed category; anything unknown counts as the background category."""
    c = F.trim(category)
    return F.when(c.isin(C.CCRE_CATEGORIES), c).otherwise(C.CCRE_DEFAULT)


def category_counts(windows: DataFrame, ccre: DataFrame, grid: int = I.BUCKET) -> DataFrame:
    """Long form: elements per (window, category) that overlap, non-zero only."""
    return I.overlap_counts(windows, ccre, ["sample_id", "chrom"], "category", grid=grid)


def window_counts(windows: DataFrame, ccre: DataFrame, grid: int = I.BUCKET) -> DataFrame:
    """Wide form: one column per category, 0 where none. Windows of samples without elements are dropped."""
    n = category_counts(windows, ccre, grid)
    wide = n.groupBy(*WINDOW).agg(*[
        F.sum(F.when(F.col("category") == c, F.col("n"))).alias(c) for c in C.CCRE_CATEGORIES])
    known = windows.join(ccre.select("sample_id").distinct(), "sample_id", "left_semi")
    return known.select(*WINDOW).join(wide, WINDOW, "left").na.fill(0, C.CCRE_CATEGORIES)


def annotation_columns(counts: DataFrame) -> DataFrame:
    """Counts plus the six derived values of the annotation vector."""
    col = {c: F.col(f"`{c}`") for c in C.CCRE_CATEGORIES}
    active = [col[c] for c in C.CCRE_CATEGORIES if c != C.CCRE_DEFAULT]
    n_active = sum(active[1:], active[0])
    total = n_active + col[C.CCRE_DEFAULT]
    size_mb = F.greatest(F.col("win_end") - F.col("win_start"), F.lit(1)) / 1e6
    some = F.greatest(n_active, F.lit(1))

    def part(n):
        p = n / some
        return F.when(n > 0, -p * F.log2(p)).otherwise(0.0)

    entropy = sum([part(n) for n in active[1:]], part(active[0]))
    return counts.select(
        *[c for c in counts.columns if c not in C.CCRE_CATEGORIES],
        *[col[c].cast("double").alias(c) for c in C.CCRE_CATEGORIES],
        n_active.cast("double").alias("n_active"), entropy.alias("regulatory_complexity"),
        (col["CA-CTCF"] / size_mb).alias("ctcf_density"), (col["PLS"] / some).alias("promoter_ratio"),
        ((col["pELS"] + col["dELS"]) / some).alias("enhancer_ratio"), (total / size_mb).alias("total_density"))


def annotate_windows(windows: DataFrame, ccre: DataFrame, grid: int = I.BUCKET) -> DataFrame:
    return annotation_columns(window_counts(windows, ccre, grid))


def annotation_vector():
    """The 16 columns as one float array, in the fixed order."""
    return F.array(*[F.col(f"`{c}`").cast("float") for c in C.CCRE_CATEGORIES + C.ANNOTATION_DERIVED])


def dominant_category():
    counts = F.array(*[F.col(f"`{c}`") for c in C.CCRE_CATEGORIES])
    listed = F.array(*[F.lit(c) for c in C.CCRE_CATEGORIES])
    return F.element_at(listed, F.array_position(counts, F.array_max(counts)).cast("int"))


def window_summary(annotated: DataFrame) -> DataFrame:
    """Per window a map from the 16 names to their values, and the dominant category."""
    names = C.CCRE_CATEGORIES + C.ANNOTATION_DERIVED
    pairs = [x for n in names for x in (F.lit(n), F.col(f"`{n}`").cast("double"))]
    return annotated.select(*WINDOW, F.create_map(*pairs).alias("summary"), dominant_category().alias("dominant_category"))


def category_lines(own, other, threshold: float = C.CCRE_DELTA):
    """Report lines of the categories whose count differs by the threshold between two annotation vectors; null if one is missing."""
    names = F.array(*[F.lit(c) for c in C.CCRE_CATEGORIES])
    delta = F.zip_with(F.slice(own, 1, len(C.CCRE_CATEGORIES)), F.slice(other, 1, len(C.CCRE_CATEGORIES)), lambda a, b: (a - b).cast("double"))
    lines = F.zip_with(names, delta, lambda n, d: F.when(F.abs(d) >= threshold, F.concat(
        F.format_string("%s: %+.0f", n, d), F.when(d > 0, " (more in query)").otherwise(" (fewer in query)"))))
    return F.when(own.isNotNull() & other.isNotNull(), F.filter(lines, lambda x: x.isNotNull()))


def element_coordinates(windows: DataFrame, ccre: DataFrame, bucket: int = I.BUCKET) -> DataFrame:
    """One row per (window, overlapping element)."""
    return (I.overlap_join(windows, ccre, ["sample_id", "chrom"], bucket=bucket)
            .select(*WINDOW, "category", "start_bp", "end_bp"))


def nested_coordinates(coords: DataFrame) -> DataFrame:
    """Per window a map category -> sorted coordinates; sized by the window, which bounds it."""
    per = coords.groupBy(*WINDOW, "category").agg(
        F.sort_array(F.collect_list(F.struct("start_bp", "end_bp"))).alias("spans"))
    return per.groupBy(*WINDOW).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("category", "spans")))).alias("coords_by_category"))


def differential(annotated: DataFrame, sample_a: str, sample_b: str) -> DataFrame:
    """Annotation of A minus B at every locus both have."""
    values = C.CCRE_CATEGORIES + C.ANNOTATION_DERIVED
    at = ["chrom", "win_start", "win_end"]

    def side(sample, mark):
        return annotated.where(F.col("sample_id") == sample).select(
            *at, *[F.col(f"`{v}`").alias(f"{mark}{v}") for v in values])

    both = side(sample_a, "a_").join(side(sample_b, "b_"), at)
    return both.select(*at, *[(F.col(f"`a_{v}`") - F.col(f"`b_{v}`")).alias(v) for v in values])


def differential_lines(diff: DataFrame, threshold: float = C.CCRE_DELTA) -> DataFrame:
    """Long form of the changes that reach their threshold, each with its report line."""
    limits = {c: float(threshold) for c in C.CCRE_CATEGORIES} | C.ANNOTATION_THRESHOLDS
    rows = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(v).alias("feature"),
                              F.col(f"`{v}`").alias("delta"), F.lit(t).alias("limit"),
                              F.lit(v in C.CCRE_CATEGORIES).alias("is_count"))
                     for i, (v, t) in enumerate(limits.items())])
    out = (diff.select("chrom", "win_start", "win_end", F.inline(rows))
           .where(F.abs("delta") >= F.col("limit")))
    d = F.col("delta")
    count = F.concat(F.format_string("%s: %+.0f", "feature", d),
                     F.when(d > 0, " (more in query)").otherwise(" (fewer in query)"))
    scalar = F.concat(F.format_string("%s: %+.3f", "feature", d),
                      F.when(d > 0, " (higher in query)").otherwise(" (lower in query)"))
    return (out.withColumn("line", F.when(F.col("is_count"), count).otherwise(scalar))
            .select("chrom", "win_start", "win_end", "line_no", "feature", "delta", "line"))


def profile_counts(ccre: DataFrame) -> DataFrame:
    """Genome-wide elements per (sample, category), 0 rows included."""
    listed = ccre.where(F.col("chrom").isin(C.CHROMOSOMES))
    wide = listed.groupBy("sample_id").agg(*[
        F.count_if(F.col("category") == c).alias(c) for c in C.CCRE_CATEGORIES])
    return wide.select("sample_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("category_no"), F.lit(c).alias("category"), F.col(f"`{c}`").alias("n"))
        for i, c in enumerate(C.CCRE_CATEGORIES)])))


def compare_profiles(ccre: DataFrame, sample_a: str, sample_b: str) -> DataFrame:
    """Counts of both samples per category and their signed difference."""
    n = profile_counts(ccre.where(F.col("sample_id").isin(sample_a, sample_b)))

    def of(s):
        return F.sum(F.when(F.col("sample_id") == s, F.col("n")).otherwise(0))
    return (n.groupBy("category_no", "category").agg(of(sample_a).alias("n_a"), of(sample_b).alias("n_b"))
            .withColumn("diff", F.col("n_a") - F.col("n_b")))


def pair_differences(ccre: DataFrame) -> DataFrame:
    """Every unordered pair of samples: summed absolute difference and its share of the larger total."""
    listed = ccre.where(F.col("chrom").isin(C.CHROMOSOMES))
    side = listed.groupBy("sample_id").agg(F.array(*[
        F.count_if(F.col("category") == c).cast("double") for c in C.CCRE_CATEGORIES]).alias("counts"))
    schema = StructType([StructField("sample_a", StringType()), StructField("sample_b", StringType())]
                        + [StructField(c, LongType()) for c in ("total_a", "total_b", "total_diff")])

    def kernel(qt, rt):
        a, b = blocks.column_values(qt, "sample_id"), blocks.column_values(rt, "sample_id")
        x, y = blocks.matrix_of(qt, "counts"), blocks.matrix_of(rt, "counts")
        out = []
        for lo, hi in blocks.row_chunks(len(x), len(y) * x.shape[1]):
            i, j = np.nonzero(a[lo:hi, None] < b[None, :])
            i = i + lo
            out.append((a[i], b[j], x[i].sum(axis=1), y[j].sum(axis=1), np.abs(x[i] - y[j]).sum(axis=1)))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string())]
                        + [pa.array(c.astype(np.int64)) for c in cols[2:]], names=schema.names)

    return (blocks.block_pairs(side, side, kernel, schema, q_block="sample_id", r_block="sample_id")
            .withColumn("pct_diff", F.col("total_diff") / F.greatest("total_a", "total_b", F.lit(1))))


# ---- genes -----------------------------------------------------------------

def with_roles(genes: DataFrame) -> DataFrame:
    return genes.withColumn("cancer_role", G.cancer_role(F.col("gene_name")))


_LOCUS = ["chrom", "win_start", "win_end"]


def _loci(windows):
    """Windows of all samples lie at the same loci: each locus meets the genes once."""
    return windows.select(*_LOCUS).distinct()


def genes_in_windows(windows: DataFrame, genes: DataFrame, bucket: int = I.BUCKET) -> DataFrame:
    """One row per (window, gene whose body overlaps it)."""
    return windows.join(I.overlap_join(_loci(windows), genes, ["chrom"], bucket=bucket), _LOCUS)


def genes_near(windows: DataFrame, genes: DataFrame, max_dist: int = 2_000_000) -> DataFrame:
    """Genes within ``max_dist`` of the window midpoint, with signed distance, label and rank."""
    mid = F.floor((F.col("win_start") + F.col("win_end")) / 2).cast("long")
    w = (_loci(windows).withColumn("_mid", mid)
         .withColumn("_lo", F.col("_mid") - max_dist - 1).withColumn("_hi", F.col("_mid") + max_dist + 1))
    near = I.overlap_join(w, genes, ["chrom"], bucket=2 * max_dist, win=("_lo", "_hi"))
    s, e = F.col("start_bp"), F.col("end_bp")
    ws, we = F.col("win_start"), F.col("win_end")
    d = G.distance_to(s, e, F.col("_mid"))
    out = (near.withColumn("distance_bp", d)
           .where((F.abs("distance_bp") <= max_dist) & (s < we + max_dist)
                  & (e > F.greatest(F.lit(0), ws - max_dist)))
           .withColumn("distance_label", G.distance_label(F.col("distance_bp")))
           .withColumn("in_window", G.in_window(s, e, ws, we)).drop("_mid", "_lo", "_hi"))
    order = Window.partitionBy(*_LOCUS).orderBy(F.abs("distance_bp"), "start_bp", "gene_id")
    return windows.join(out.withColumn("rank", F.row_number().over(order)), _LOCUS)


_GENE = ["start_bp", "gene_id", "end_bp", "gene_name", "gene_type", "cancer_role"]  # in the order that settles ties


def _candidates(genes: DataFrame, max_dist: int, width: int) -> DataFrame:
    """Per grid cell the genes that can be nearest to a position in it, a row each.

    These are the genes that touch the cell, the last one to end before it and
    the first one to start after it. The windows run over cells, whose number
    per chromosome is set by the genome length.
    """
    known = genes.where(F.col("chrom").isNotNull() & F.col("start_bp").isNotNull() & (F.col("end_bp") > 0))
    g = known.select("chrom", "start_bp", "end_bp", F.struct(*_GENE).alias("gene"))
    cell = lambda x: F.floor(x / width).cast("long")
    starts = g.groupBy("chrom", cell(F.col("start_bp")).alias("cell")).agg(F.min("gene").alias("first_start"))
    latest = F.min(F.struct((-F.col("end_bp")).alias("neg"), "gene"))
    ends = g.groupBy("chrom", cell(F.col("end_bp")).alias("cell")).agg(latest.alias("last_end"))
    span = g.groupBy("chrom").agg(F.min("start_bp").alias("lo"), F.max("end_bp").alias("hi"))
    cells = span.select("chrom", F.explode(F.sequence(
        cell(F.col("lo") - max_dist) - 1, cell(F.col("hi") + max_dist) + 1)).alias("cell"))
    # both frames grow from the start; a frame open at the end would be recomputed per row
    before = Window.partitionBy("chrom").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("chrom").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    edge = (cells.join(starts, ["chrom", "cell"], "left").join(ends, ["chrom", "cell"], "left")
            .select("chrom", "cell", F.min("last_end").over(before)["gene"].alias("left"),
                    F.min("first_start").over(after).alias("right"))
            .select("chrom", "cell", F.explode(F.array_compact(F.array("left", "right"))).alias("gene")))
    inside = g.select("chrom", F.explode(F.sequence(cell(F.col("start_bp")), cell(F.col("end_bp")))).alias("cell"), "gene")
    return inside.unionByName(edge).select("chrom", "cell", "gene.*")


def _nearest(pos, start, end, max_dist):
    """(gene, signed distance) per position, gene -1 where none is in reach; genes come sorted by start and tie order.

    The first gene to cover a position is the first whose end lifts the running maximum to it; else the nearest are the last to end
    before it and the first to start after it. So a position costs three searches, however many genes its cell has.
    """
    far = np.searchsorted(np.maximum.accumulate(end), np.maximum(pos, pos - max_dist + 1), "left")
    right = np.searchsorted(start, pos, "right")
    covered = far < right
    by_end = np.lexsort((-np.arange(len(end)), end))
    left = np.searchsorted(end[by_end], pos, "left") - 1
    before, after = by_end[np.maximum(left, 0)], np.minimum(right, len(start) - 1)
    d_left, d_right = pos - end[before], start[after] - pos
    has_left, has_right = (left >= 0) & (d_left < max_dist), (right < len(start)) & (d_right <= max_dist)
    has_left &= ~has_right | (d_left <= d_right)
    gene = np.where(covered, far, np.where(has_left, before, np.where(has_right, after, -1)))
    return gene, np.where(covered, 0, np.where(has_left, -d_left, d_right))


def nearest_genes(positions: DataFrame, genes: DataFrame, max_dist: int = 2_000_000, width: int = 100_000) -> DataFrame:
    """Nearest gene of every distinct (chrom, pos); all NULL where none is in reach.

    Every position belongs to one grid cell and meets that cell's candidates once, sorted; its gene is found by search, so the work
    does not grow with the genes of a cell. A cell holds at most ``width`` distinct positions.
    """
    known = F.col("chrom").isNotNull() & F.col("pos").isNotNull()
    w = positions.select("chrom", "pos").distinct()
    near = _candidates(genes, max_dist, width)
    kept = ["gene_name", "gene_id", "cancer_role", "gene_type"]
    schema = StructType([w.schema["chrom"], StructField("pos", LongType())] + [StructField(c, near.schema[c].dataType) for c in kept]
                        + [StructField("distance_bp", LongType())])
    arrow = to_arrow_schema(schema)

    def chosen(p, g):
        pos = p.column("pos").to_numpy()
        if g.num_rows and p.num_rows:
            g = g.take(pc.sort_indices(g, [(c, "ascending") for c in _GENE], null_placement="at_start"))
            gene, far = _nearest(pos, g.column("start_bp").to_numpy(), g.column("end_bp").to_numpy(), max_dist)
        else:
            gene, far = np.full(len(pos), -1), np.zeros(len(pos), np.int64)
        none = gene < 0
        at = pa.array(gene, mask=none)
        return pa.Table.from_arrays([p.column("chrom"), p.column("pos"), *[g.column(c).take(at) for c in kept],
                                     pa.array(far, mask=none)], names=arrow.names).cast(arrow)

    by = ["chrom", "cell"]
    placed = w.where(known).select("chrom", F.col("pos").cast("long").alias("pos"), F.floor(F.col("pos") / width).cast("long").alias("cell"))
    found = placed.groupBy(*by).cogroup(near.groupBy(*by)).applyInArrow(chosen, schema)
    found = found.unionByName(w.where(~known), allowMissingColumns=True)
    return found.select("chrom", "pos", "gene_name", "gene_id", "distance_bp",
                        G.distance_label(F.col("distance_bp")).alias("distance_label"), "cancer_role", "gene_type")


def annotate_elements(coords: DataFrame, genes: DataFrame, max_dist: int = 500_000) -> DataFrame:
    """Nearest gene of every element hit, else intergenic, with the report rank per window and category.

    Elements sit at the same coordinates in many samples and windows, so each
    midpoint is looked up once. Cancer genes rank first, then by distance; a
    distance of 0 counts as missing in that order.
    """
    hits = coords.withColumn("pos", F.floor((F.col("start_bp") + F.col("end_bp")) / 2).cast("long"))
    found = hits.join(nearest_genes(hits, genes, max_dist), ["chrom", "pos"], "left")
    far = F.coalesce(F.nullif(F.abs("distance_bp"), F.lit(0)), F.lit(999_999_999))
    order = Window.partitionBy(*WINDOW, "category").orderBy(
        F.when(F.col("cancer_role").isNull(), 1).otherwise(0), far, "start_bp", "end_bp")
    return (found.withColumn("rank", F.row_number().over(order))
            .withColumn("nearest_gene", F.coalesce("gene_name", F.lit("intergenic")))
            .withColumn("distance_label", F.coalesce("distance_label", F.lit("intergenic")))
            .withColumn("size_bp", F.col("end_bp") - F.col("start_bp")).drop("pos", "gene_name"))


def boundary_losses(positions: DataFrame, genes: DataFrame, max_dist: int = 500_000) -> DataFrame:
    """Three nearest genes on each side of every lost boundary (chrom, pos), with the note."""
    sides = positions.select("chrom", "pos", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), (F.col("pos") - max_dist).alias("win_start"), F.col("pos").alias("win_end")),
        F.struct(F.lit(1).alias("side"), F.col("pos").alias("win_start"), (F.col("pos") + max_dist).alias("win_end")))))
    top = genes_near(sides, genes, max_dist).where("rank <= 3")
    one = F.struct("side", "rank", "gene_name", "cancer_role")
    listed = top.groupBy("chrom", "pos").agg(F.sort_array(F.collect_list(one)).alias("_g"))
    out = positions.select("chrom", "pos").distinct().join(listed, ["chrom", "pos"], "left")
    g = F.coalesce(F.col("_g"), F.array().cast("array<struct<side:int,rank:int,gene_name:string,cancer_role:string>>"))

    def names(keep):
        return F.transform(F.filter(g, keep), lambda x: x["gene_name"])

    return out.select(
        "chrom", "pos", names(lambda x: x["side"] == 0).alias("left_genes"),
        names(lambda x: x["side"] == 1).alias("right_genes"),
        names(lambda x: x["cancer_role"].isNotNull()).alias("cancer_genes"),
        G.boundary_note(names(lambda x: x["rank"] > 0)).alias("clinical_note"))


def compartment_switches(switches: DataFrame, genes: DataFrame, max_dist: int = 200_000) -> DataFrame:
    """Genes inside every switched region (chrom, win_start, win_end, direction) and its consequence."""
    key = ["chrom", "win_start", "win_end", "direction"]
    inside = genes_in_windows(switches.select(*key), genes).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("start_bp", "gene_id", "gene_name", "cancer_role"))).alias("_in"))
    near = (genes_near(switches.select(*key), genes, max_dist).where("rank <= 3").groupBy(*key)
            .agg(F.sort_array(F.collect_list(F.struct("rank", "gene_name"))).alias("_near")))
    none = F.array().cast("array<string>")

    def names(col, keep=None):
        a = F.col(col) if keep is None else F.filter(col, keep)
        return F.coalesce(F.transform(a, lambda x: x["gene_name"]), none)

    out = (switches.select(*key).distinct().join(inside, key, "left").join(near, key, "left")
           .withColumn("genes_in_region", names("_in"))
           .withColumn("cancer_genes", names("_in", lambda x: x["cancer_role"].isNotNull()))
           .withColumn("nearby_genes", names("_near")).drop("_in", "_near"))
    direction, cancer = F.col("direction"), F.col("cancer_genes")
    return (out.withColumn("size_bp", F.col("win_end") - F.col("win_start"))
            .withColumn("functional_consequence", G.compartment_consequence(direction, cancer))
            .withColumn("clinical_note", G.compartment_note(direction, cancer)))


# ---- matching files to cells ----------------------------------------------

def _prefixes(name):
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name))), lambda i: F.substring(name, F.lit(1), i))


def match_annotation_files(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Annotation file of every cell: exact name, else a prefix either way ignoring case, first path.

    ``files`` has key and path. A prefix match is an equality with one of the
    prefixes of the longer name, so these are equi joins.
    """
    c = cells.select("cell").distinct().withColumn("_lc", F.lower("cell"))
    f = files.select("key", "path").withColumn("_lk", F.lower("key"))
    exact = c.join(f, c["cell"] == f["key"]).select("cell", F.lit(0).alias("p"), "path")
    longer = (c.withColumn("_pre", F.explode(_prefixes(F.col("_lc")))).join(f, F.col("_pre") == F.col("_lk"))
              .select("cell", F.lit(1).alias("p"), "path"))
    shorter = (f.withColumn("_pre", F.explode(_prefixes(F.col("_lk")))).join(c, F.col("_pre") == F.col("_lc"))
               .select("cell", F.lit(1).alias("p"), "path"))
    best = exact.unionByName(longer).unionByName(shorter).groupBy("cell").agg(
        F.min(F.struct("p", "path"))["path"].alias("annotation_path"))
    return c.select("cell").join(best, "cell", "left")


def annotation_registry(samples: DataFrame, files: DataFrame, directory: str = "") -> DataFrame:
    """Annotation path per sample id as discovered, or the fixed entries below ``directory`` when nothing is."""
    found = discover_annotations(samples, files)
    fixed = found.sparkSession.createDataFrame(C.FALLBACK_ANNOTATIONS, "sample_id string, path string").select(
        "sample_id", F.concat(F.lit(directory.rstrip("/") + "/" if directory else ""), "path").alias("path"))
    none = found.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar() == 0
    return found.unionByName(fixed.where(none))


def discover_annotations(samples: DataFrame, files: DataFrame, extension: str = ".bed.gz") -> DataFrame:
    """Annotation path per sample id: exact file name, file name starting with it, cleaned name equal to it."""
    s = samples.select("sample_id").distinct()
    f = files.select("path", F.element_at(F.split("path", "/"), -1).alias("_file"))
    stem = F.regexp_replace("_file", extension.replace(".", r"\.") + "$", "")
    tries = [
        f.select("path", stem.alias("sample_id"), F.lit(0).alias("p")),
        f.select("path", F.explode(_prefixes(F.col("_file"))).alias("sample_id"), F.lit(1).alias("p")),
        f.select("path", N.strip_accession(stem).alias("sample_id"), F.lit(2).alias("p")),
    ]
    every = tries[0].unionByName(tries[1]).unionByName(tries[2])
    return (s.join(every, "sample_id").groupBy("sample_id")
            .agg(F.min(F.struct("p", "path"))["path"].alias("path")))
