"""Interval joins, regulatory and gene annotation."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import genes as G
from ..operators import annotation as A
from ..operators import intervals as I
from ..plans import regulatory
from .base import define, oracle, r6, registry

QUERIES, ORACLES, register = registry()

_CATS = C.CCRE_CATEGORIES
define("hits", """
SELECT w.sample_id, w.chrom, w.win_start, w.win_end, c.category, c.start_bp, c.end_bp
FROM windows w JOIN ccre_clean c ON c.sample_id = w.sample_id AND c.chrom = w.chrom
  AND c.start_bp < w.win_end AND c.end_bp > w.win_start""", ["windows", "ccre_clean"])
_pivot = ", ".join(f"count(h.category) FILTER (h.category = '{c}') AS \"{c}\"" for c in _CATS)
define("wide", f"""
SELECT w.sample_id, w.chrom, w.win_start, w.win_end, {_pivot} FROM windows w
LEFT JOIN hits h USING (sample_id, chrom, win_start, win_end)
WHERE w.sample_id IN (SELECT sample_id FROM ccre) GROUP BY 1,2,3,4""", ["windows", "hits", "ccre"])
_act = [c for c in _CATS if c != "Low-DNase"]
_n = "(" + "+".join(f'"{c}"' for c in _act) + ")"
_ent = "+".join(f'CASE WHEN "{c}" > 0 THEN -("{c}"*1.0E0/{_n})*log2("{c}"*1.0E0/{_n}) ELSE 0.0E0 END' for c in _act)
define("annot", f"""
SELECT sample_id, chrom, win_start, win_end, {", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in _CATS)},
  CAST({_n} AS DOUBLE) AS n_active, {_ent} AS regulatory_complexity,
  "CA-CTCF"*1e6/(win_end - win_start) AS ctcf_density, "PLS"*1.0E0/greatest({_n}, 1) AS promoter_ratio,
  ("pELS" + "dELS")*1.0E0/greatest({_n}, 1) AS enhancer_ratio,
  ({_n} + "Low-DNase")*1e6/(win_end - win_start) AS total_density FROM wide""", ["wide"])


def _ccre(fx):
    return fx.ccre.withColumn("category", A.clean_category(F.col("category")))


def _genes(fx):
    return A.with_roles(fx.genes)


@register("ccre_overlap_counts", """
SELECT sample_id, chrom, win_start, win_end, category, count(*) AS n FROM hits GROUP BY ALL""", ["hits"])
def ccre_overlap_counts(fx):
    return A.category_counts(fx.windows, _ccre(fx))


# windows off the grid go through the row-level join
@register("ccre_overlap_counts_shifted", """
SELECT w.sample_id, w.chrom, w.win_start + 50017 AS win_start, w.win_end + 50017 AS win_end, c.category, count(*) AS n
FROM windows w JOIN ccre_clean c ON c.sample_id = w.sample_id AND c.chrom = w.chrom
  AND c.start_bp < w.win_end + 50017 AND c.end_bp > w.win_start + 50017 GROUP BY ALL""", ["windows", "ccre_clean"])
def ccre_overlap_counts_shifted(fx):
    w = fx.windows.withColumn("win_start", F.col("win_start") + 50017).withColumn("win_end", F.col("win_end") + 50017)
    return A.category_counts(w, _ccre(fx))


_derived = ", ".join(f"round({c}, 6) + 0.0E0 AS {c}" for c in C.ANNOTATION_DERIVED)


@register("ccre_annotation", f"""
SELECT sample_id, chrom, win_start, win_end, {", ".join(f'"{c}"' for c in _CATS)}, {_derived} FROM annot""", ["annot"])
def ccre_annotation(fx):
    a = A.annotate_windows(fx.windows, _ccre(fx))
    return a.select(*A.WINDOW, *[f"`{c}`" for c in _CATS], *[r6(c) for c in C.ANNOTATION_DERIVED])


@register("ccre_dominant", f"""
SELECT sample_id, chrom, win_start, win_end, ([{", ".join(f"'{c}'" for c in _CATS)}])[
  list_position([{", ".join(f'"{c}"' for c in _CATS)}], greatest({", ".join(f'"{c}"' for c in _CATS)}))] AS dominant
FROM wide""", ["wide"])
def ccre_dominant(fx):
    return A.window_counts(fx.windows, _ccre(fx)).select(*A.WINDOW, A.dominant_category().alias("dominant"))


@register("window_summary", f"""
SELECT sample_id, chrom, win_start, win_end, dominant, feature, round(value, 6) + 0.0E0 AS value FROM (
  SELECT sample_id, chrom, win_start, win_end, [{", ".join(f"'{c}'" for c in _CATS)}][
    list_position([{", ".join(f'"{c}"' for c in _CATS)}], greatest({", ".join(f'"{c}"' for c in _CATS)}))] AS dominant,
    unnest([{", ".join(f"'{c}'" for c in _CATS + C.ANNOTATION_DERIVED)}]) AS feature,
    unnest([{", ".join(f'"{c}"' for c in _CATS + C.ANNOTATION_DERIVED)}]) AS value FROM annot)""", ["annot"])
def window_summary(fx):
    s = A.window_summary(A.annotate_windows(fx.windows, _ccre(fx)))
    return s.select(*A.WINDOW, F.col("dominant_category").alias("dominant"), F.explode("summary").alias("feature", "value")).select(
        *A.WINDOW, "dominant", "feature", r6("value"))


@register("ccre_coords", "SELECT * FROM hits", ["hits"])
def ccre_coords(fx):
    return A.element_coordinates(fx.windows, _ccre(fx))


@register("ccre_coords_nested", """
SELECT sample_id, chrom, win_start, win_end, count(DISTINCT category) AS n_categories, count(*) AS n_elements,
  min(start_bp) FILTER (category = 'PLS') AS first_promoter FROM hits GROUP BY 1,2,3,4""", ["hits"])
def ccre_coords_nested(fx):
    n = A.nested_coordinates(A.element_coordinates(fx.windows, _ccre(fx)))
    m = F.col("coords_by_category")
    total = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, x: s + F.size(x))
    return n.select(*A.WINDOW, F.size(F.map_keys(m)).cast("long").alias("n_categories"), total.alias("n_elements"),
                    F.get(F.try_element_at(m, F.lit("PLS")), F.lit(0))["start_bp"].alias("first_promoter"))


@register("ccre_compare", """
SELECT category, count(*) FILTER (sample_id = 'CT0') AS n_a, count(*) FILTER (sample_id = 'CT1') AS n_b,
  count(*) FILTER (sample_id = 'CT0') - count(*) FILTER (sample_id = 'CT1') AS diff
FROM ccre_clean GROUP BY 1""", ["ccre_clean"])
def ccre_compare(fx):
    return A.compare_profiles(_ccre(fx), "CT0", "CT1").select("category", "n_a", "n_b", "diff")


@register("ccre_pair_diff", """
SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, CAST(sum(a.n) AS BIGINT) AS total_a,
  CAST(sum(b.n) AS BIGINT) AS total_b, CAST(sum(abs(a.n - b.n)) AS BIGINT) AS total_diff,
  round(sum(abs(a.n - b.n))/greatest(sum(a.n), sum(b.n), 1), 6) AS pct_diff
FROM per a JOIN per b ON a.category = b.category AND a.sample_id < b.sample_id GROUP BY 1,2""", ["per"])
def ccre_pair_diff(fx):
    return A.pair_differences(_ccre(fx)).select("sample_a", "sample_b", "total_a", "total_b", "total_diff", r6("pct_diff"))


define("per", """
SELECT s.sample_id, k.category, count(c.category) AS n
FROM (SELECT DISTINCT sample_id FROM ccre_clean) s CROSS JOIN (SELECT DISTINCT category FROM ccre_clean) k
LEFT JOIN ccre_clean c ON c.sample_id = s.sample_id AND c.category = k.category GROUP BY 1,2""", ["ccre_clean"])

_all = _CATS + C.ANNOTATION_DERIVED
_thr = {c: 2.0 for c in _CATS} | C.ANNOTATION_THRESHOLDS
_parts = " UNION ALL ".join(
    f"SELECT a.chrom, a.win_start, a.win_end, '{c}' AS feature, a.\"{c}\" - b.\"{c}\" AS delta, {t} AS lim, "
    f"{'TRUE' if c in _CATS else 'FALSE'} AS is_count FROM annot a JOIN annot b USING (chrom, win_start, win_end) "
    f"WHERE a.sample_id = 'CT0' AND b.sample_id = 'CT1'" for c, t in _thr.items())


@register("ccre_differential", f"""
SELECT chrom, win_start, win_end, feature, round(delta, 6) + 0.0E0 AS delta,
  CASE WHEN is_count THEN concat(feature, printf(': %+.0f', delta),
      CASE WHEN delta > 0 THEN ' (more in query)' ELSE ' (fewer in query)' END)
    ELSE concat(feature, CASE WHEN delta > 0 THEN ' higher' ELSE ' lower' END) END AS line
FROM ({_parts}) WHERE abs(delta) >= lim""", ["annot"])
def ccre_differential(fx):
    d = A.differential(A.annotate_windows(fx.windows, _ccre(fx)), "CT0", "CT1")
    lines = A.differential_lines(d, 2.0)
    text = F.when(F.col("feature").isin(_CATS), F.col("line")).otherwise(
        F.concat("feature", F.when(F.col("delta") > 0, " higher").otherwise(" lower")))
    return lines.select("chrom", "win_start", "win_end", "feature", r6("delta"), text.alias("line"))


@register("gene_roles", "SELECT gene_id, gene_name, cancer_role FROM gene_roles", ["gene_roles"])
def gene_roles(fx):
    return _genes(fx).select("gene_id", "gene_name", "cancer_role")


@register("genes_in_window", """
SELECT w.chr AS chrom, w.start_bp AS win_start, w.end_bp AS win_end, g.gene_id, g.gene_name
FROM loci w JOIN genes g ON g.chrom = w.chr AND g.start_bp < w.end_bp AND g.end_bp > w.start_bp""", ["loci", "genes"])
def genes_in_window(fx):
    return A.genes_in_windows(fx.loci, fx.genes).select("chrom", "win_start", "win_end", "gene_id", "gene_name")


# a gene's signed distance to a position, as SQL text
def _dist(pos):
    return f"CASE WHEN {pos} < g.start_bp THEN g.start_bp - {pos} WHEN {pos} > g.end_bp THEN g.end_bp - {pos} ELSE 0 END"


def _near(source, start, end, md):
    mid = f"(({start} + {end}) // 2)"
    return f"""
SELECT w.*, g.gene_id, g.gene_name, g.start_bp AS gs, g.end_bp AS ge, g.cancer_role, {_dist(mid)} AS distance_bp
FROM {source} w JOIN gene_roles g ON g.chrom = w.chrom
  AND g.start_bp < {end} + {md} AND g.end_bp > greatest(0, {start} - {md}) AND abs({_dist(mid)}) <= {md}"""


define("gwin", "SELECT chr AS chrom, start_bp AS win_start, end_bp AS win_end FROM loci", ["loci"])
define("gnear", _near("gwin", "w.win_start", "w.win_end", 2000000), ["gwin", "gene_roles"])


@register("genes_near", """
SELECT chrom, win_start, win_end, gene_id, distance_bp,
  CASE WHEN distance_bp = 0 THEN 'overlapping'
       WHEN distance_bp > 0 THEN concat(CAST(round_even(abs(distance_bp)/1000, 0) AS BIGINT), 'kb upstream')
       ELSE concat(CAST(round_even(abs(distance_bp)/1000, 0) AS BIGINT), 'kb downstream') END AS distance_label,
  (gs BETWEEN win_start AND win_end OR ge BETWEEN win_start AND win_end OR (gs <= win_start AND win_start <= ge))
    AS in_window,
  row_number() OVER (PARTITION BY chrom, win_start ORDER BY abs(distance_bp), gs, gene_id) AS rank
FROM gnear""", ["gnear"])
def genes_near(fx):
    return A.genes_near(fx.loci, _genes(fx)).select(
        "chrom", "win_start", "win_end", "gene_id", "distance_bp", "distance_label", "in_window",
        F.col("rank").cast("long").alias("rank"))


define("mids", "SELECT DISTINCT chrom, (start_bp + end_bp) // 2 AS pos FROM ccre", ["ccre"])
define("mid_near", _near("mids", "w.pos", "(w.pos + 1)", 500000).replace("((w.pos + (w.pos + 1)) // 2)", "w.pos"),
       ["mids", "gene_roles"])
define("mid_first", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY abs(distance_bp), gs, gene_id) AS rn
FROM mid_near) WHERE rn = 1""", ["mid_near"])


@register("nearest_gene", """
SELECT chrom, pos, f.gene_id, f.gene_name, f.distance_bp, f.cancer_role
FROM mids LEFT JOIN mid_first f USING (chrom, pos)""", ["mids", "mid_first"])
def nearest_gene(fx):
    p = fx.ccre.select("chrom", F.floor((F.col("start_bp") + F.col("end_bp")) / 2).cast("long").alias("pos"))
    return A.nearest_genes(p, _genes(fx), 500_000).select(
        "chrom", "pos", "gene_id", "gene_name", "distance_bp", "cancer_role")


@register("ccre_gene_hits", """
SELECT h.sample_id, h.chrom, h.win_start, h.win_end, h.category, h.start_bp, h.end_bp,
  coalesce(m.gene_name, 'intergenic') AS nearest_gene, m.distance_bp, m.cancer_role
FROM hits h LEFT JOIN mid_first m ON m.chrom = h.chrom AND m.pos = (h.start_bp + h.end_bp) // 2""",
          ["hits", "mid_first"])
def ccre_gene_hits(fx):
    c = A.element_coordinates(fx.windows, _ccre(fx))
    return A.annotate_elements(c, _genes(fx)).select(
        *A.WINDOW, "category", "start_bp", "end_bp", "nearest_gene", "distance_bp", "cancer_role")


# boundaries: every window edge
define("bounds", "SELECT DISTINCT chr AS chrom, start_bp + 6400000 AS pos FROM loci", ["loci"])
define("bsides", """
SELECT chrom, pos, 0 AS side, pos - 500000 AS win_start, pos AS win_end FROM bounds
UNION ALL SELECT chrom, pos, 1, pos, pos + 500000 FROM bounds""", ["bounds"])
define("bnear", _near("bsides", "w.win_start", "w.win_end", 500000), ["bsides", "gene_roles"])
define("btop", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, side ORDER BY abs(distance_bp), gs, gene_id) AS rk
FROM bnear) WHERE rk <= 3""", ["bnear"])


@register("boundary_flanks", """
SELECT chrom, pos, left_genes, right_genes, cancer_genes, CASE
  WHEN has_myc THEN 'MYC TAD boundary disruption — oncogene activation risk'
  WHEN has_tp53 THEN 'TP53 TAD disruption — tumor suppressor dysregulation'
  WHEN has_ctcf THEN 'CTCF gene boundary loss — genome organization disruption'
  WHEN has_ezh2 THEN 'EZH2 oncogene near disrupted boundary' END AS clinical_note FROM (
SELECT b.chrom, b.pos,
  coalesce(string_agg(t.gene_name, ',' ORDER BY rk) FILTER (side = 0), '') AS left_genes,
  coalesce(string_agg(t.gene_name, ',' ORDER BY rk) FILTER (side = 1), '') AS right_genes,
  coalesce(string_agg(t.gene_name, ',' ORDER BY side, rk) FILTER (cancer_role IS NOT NULL), '') AS cancer_genes,
  bool_or(t.gene_name = 'MYC') AS has_myc, bool_or(t.gene_name = 'TP53') AS has_tp53,
  bool_or(t.gene_name = 'CTCF') AS has_ctcf, bool_or(t.gene_name = 'EZH2') AS has_ezh2
FROM bounds b LEFT JOIN btop t USING (chrom, pos) GROUP BY 1,2)""", ["bounds", "btop"])
def boundary_flanks(fx):
    p = fx.loci.select("chrom", (F.col("win_start") + 6400000).alias("pos")).distinct()
    return A.boundary_losses(p, _genes(fx)).select(
        "chrom", "pos", *[F.array_join(c, ",").alias(c) for c in ("left_genes", "right_genes", "cancer_genes")],
        "clinical_note")


# switches: one region per locus, direction by start
define("sw", """
SELECT chrom, win_start, win_start + 400000 AS win_end,
  CASE WHEN (win_start // 12800000) % 2 = 0 THEN 'A->B' ELSE 'B->A' END AS direction FROM gwin""", ["gwin"])
define("swnear", _near("sw", "w.win_start", "w.win_end", 200000), ["sw", "gene_roles"])


@register("compartment_genes", """
SELECT s.chrom, s.win_start, s.win_end, s.direction,
  coalesce(i.genes, '') AS genes_in_region, coalesce(i.cancer, '') AS cancer_genes, coalesce(n.near, '') AS nearby_genes,
  CASE s.direction WHEN 'B->A' THEN CASE WHEN i.cancer IS NOT NULL THEN concat('Activation of ', i.two,
      ' (heterochromatin→euchromatin)') ELSE 'Gene activation (heterochromatin→euchromatin shift)' END
    ELSE CASE WHEN i.cancer IS NOT NULL THEN concat('Silencing of ', i.two, ' (euchromatin→heterochromatin)')
      ELSE 'Gene silencing (euchromatin→heterochromatin shift)' END END AS functional_consequence,
  CASE WHEN i.cancer IS NULL THEN NULL
    WHEN i.one IN ('MYC', 'EZH2') AND s.direction = 'B->A'
      THEN concat(i.one, ' oncogene activation via compartment switch — high risk')
    WHEN i.one IN ('MYC', 'EZH2') THEN concat(i.one, ' oncogene silenced — potential protective effect')
    WHEN i.one = 'TP53' AND s.direction = 'B->A' THEN 'TP53 tumor suppressor activated — potential protective effect'
    WHEN i.one = 'TP53' THEN 'TP53 tumor suppressor silenced via compartment switch — high risk'
    ELSE concat(i.one, ' cancer gene affected by compartment switch') END AS clinical_note
FROM sw s LEFT JOIN (
  SELECT w.chrom, w.win_start, string_agg(g.gene_name, ',' ORDER BY g.start_bp, g.gene_id) AS genes,
    string_agg(g.gene_name, ',' ORDER BY g.start_bp, g.gene_id) FILTER (g.cancer_role IS NOT NULL) AS cancer,
    array_to_string((list(g.gene_name ORDER BY g.start_bp, g.gene_id) FILTER (g.cancer_role IS NOT NULL))[1:2], ', ') AS two,
    first(g.gene_name ORDER BY g.start_bp, g.gene_id) FILTER (g.cancer_role IS NOT NULL) AS one
  FROM sw w JOIN gene_roles g ON g.chrom = w.chrom AND g.start_bp < w.win_end AND g.end_bp > w.win_start
  GROUP BY 1,2) i USING (chrom, win_start)
LEFT JOIN (SELECT chrom, win_start, string_agg(gene_name, ',' ORDER BY rk) AS near FROM (
  SELECT *, row_number() OVER (PARTITION BY chrom, win_start ORDER BY abs(distance_bp), gs, gene_id) AS rk FROM swnear)
  WHERE rk <= 3 GROUP BY 1,2) n USING (chrom, win_start)""", ["sw", "swnear", "gene_roles"])
def compartment_genes(fx):
    direction = F.when(F.floor(F.col("win_start") / 12800000) % 2 == 0, "A->B").otherwise("B->A")
    sw = fx.loci.select("chrom", "win_start", (F.col("win_start") + 400000).alias("win_end"),
                        direction.alias("direction"))
    return A.compartment_switches(sw, _genes(fx)).select(
        "chrom", "win_start", "win_end", "direction",
        *[F.array_join(c, ",").alias(c) for c in ("genes_in_region", "cancer_genes", "nearby_genes")],
        "functional_consequence", "clinical_note")


def _context(fx):
    direction = F.when(F.floor(F.col("win_start") / 12800000) % 2 == 0, "A->B").otherwise("B->A")
    pos = fx.loci.select("chrom", (F.col("win_start") + 6400000).alias("pos")).distinct()
    sw = fx.loci.select("chrom", "win_start", (F.col("win_start") + 400000).alias("win_end"), direction.alias("direction"))
    return regulatory.structure_context(pos, sw, fx.genes)


@register("structure_boundaries", *ORACLES["boundary_flanks"])
def structure_boundaries(fx):
    return _context(fx)[0].select("chrom", "pos", *[F.array_join(c, ",").alias(c) for c in ("left_genes", "right_genes", "cancer_genes")],
                                  "clinical_note")


@register("structure_switches", *ORACLES["compartment_genes"])
def structure_switches(fx):
    return _context(fx)[1].select("chrom", "win_start", "win_end", "direction",
                                  *[F.array_join(c, ",").alias(c) for c in ("genes_in_region", "cancer_genes", "nearby_genes")],
                                  "functional_consequence", "clinical_note")


@register("differential_report", f"""
SELECT chrom, win_start, win_end, feature, concat(feature, ': ', printf(CASE WHEN is_count THEN '%+.0f' ELSE '%+.3f' END, round(delta, 3)),
  CASE WHEN is_count AND delta > 0 THEN ' (more in query)' WHEN is_count THEN ' (fewer in query)'
    WHEN delta > 0 THEN ' (higher in query)' ELSE ' (lower in query)' END) AS line
FROM ({_parts}) WHERE abs(delta) >= lim""", ["annot"])
def differential_report(fx):
    """The whole report line, scalar features included."""
    return regulatory.differential_report(fx.windows, _ccre(fx), "CT0", "CT1", 2.0).select(
        "chrom", "win_start", "win_end", "feature", "line")


@register("ccre_report", """
SELECT category, n_a, n_b, CASE WHEN n_a > n_b THEN concat('+', n_a - n_b, ' ▲')
  WHEN n_a < n_b THEN concat(n_a - n_b, ' ▼') ELSE '  =' END AS difference FROM (
  SELECT category, count(*) FILTER (sample_id = 'CT0') AS n_a, count(*) FILTER (sample_id = 'CT1') AS n_b
  FROM ccre_clean GROUP BY 1) WHERE n_a > 0 OR n_b > 0""", ["ccre_clean"])
def ccre_report(fx):
    from ..plans.collection import pair_regulatory_report
    return pair_regulatory_report(_ccre(fx), "CT0", "CT1").select("category", "n_a", "n_b", "difference")


# divergent windows of the locus query, annotated with the elements of their best cell type
define("lost", """
SELECT DISTINCT top_cell_type AS sample_id, chr AS chrom, start_bp AS win_start, end_bp AS win_end
FROM win WHERE similarity < 0.3""", ["win"])


@register("divergent_regulatory", """
SELECT l.sample_id, l.chrom, l.win_start, h.category, h.start_bp, coalesce(m.gene_name, 'intergenic') AS nearest_gene,
  m.distance_bp, row_number() OVER (PARTITION BY l.sample_id, l.chrom, l.win_start, h.category
    ORDER BY CASE WHEN m.cancer_role IS NULL THEN 1 ELSE 0 END, coalesce(nullif(abs(m.distance_bp), 0), 999999999),
      h.start_bp, h.end_bp) AS rank
FROM lost l JOIN hits h USING (sample_id, chrom, win_start, win_end)
LEFT JOIN mid_first m ON m.chrom = h.chrom AND m.pos = (h.start_bp + h.end_bp) // 2""", ["lost", "hits", "mid_first"])
def divergent_regulatory(fx):
    from ..operators import rollups as R
    from ..operators import similarity as S
    from ..plans.regulatory import divergent_context
    q = fx.members("query")
    w = S.window_results(q, S.locus_matches(q, fx.members("ref"), 1))
    lost = R.divergent_windows(w).select(F.col("top_cell_type").alias("sample_id"), "chr", "start_bp", "end_bp")
    return divergent_context(lost, _ccre(fx), fx.genes).select(
        "sample_id", "chrom", "win_start", "category", "start_bp", "nearest_gene", "distance_bp",
        F.col("rank").cast("long").alias("rank"))
