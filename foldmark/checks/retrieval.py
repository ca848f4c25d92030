"""Locus search, votes, roll-ups, whole-collection similarity and comparison."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import labels as L
from ..functions import names as N
from ..operators import rollups as R
from ..operators import similarity as S
from ..plans import collection, locus_report
from .base import define, r6, registry

QUERIES, ORACLES, register = registry()


def _matches(fx, k=5):
    return S.locus_matches(fx.members("query"), fx.members("ref"), k)


def _windows(fx):
    q = fx.members("query")
    return S.window_results(q, S.locus_matches(q, fx.members("ref"), 5))


@register("locus_topk", """
SELECT sample_id, chr, start_bp, rank, match_sample, match_cell_type, match_tissue, round(score, 6) AS score,
  CASE WHEN score > 0.7 THEN 'STRUCTURALLY_SIMILAR' WHEN score > 0.3 THEN 'PARTIALLY_SIMILAR'
       ELSE 'STRUCTURALLY_DIFFERENT' END AS status
FROM locus_ranked WHERE rank <= 5""", ["locus_ranked"])
def locus_topk(fx):
    return _matches(fx).select("sample_id", "chr", "start_bp", F.col("rank").cast("bigint").alias("rank"),
                               "match_sample", "match_cell_type", "match_tissue", r6("score"), "status")


define("gap_pairs", """
SELECT q.sample_id, q.id, q.chr, q.start_bp, r.id AS rid, r.chr AS rchr, r.start_bp AS rstart, r.sample_id AS match_sample,
  r.cell_type, list_dot_product(q.v, r.v)/(q.len*r.len) AS score
FROM members q, members r WHERE q.role = 'query' AND r.role = 'ref'
  AND q.id % 11 <> 3 AND q.id % 13 <> 5 AND r.id % 11 <> 3 AND r.id % 13 <> 5""", ["members"])


def _gaps(fx, role):
    """Members of which some have no vector and some one of NaN."""
    v = F.col("fingerprint")
    nan = F.transform(v, lambda x: F.lit(float("nan")).cast("float"))
    return fx.members(role).withColumn(
        "fingerprint", F.when(F.col("id") % 11 == 3, F.lit(None)).when(F.col("id") % 13 == 5, nan).otherwise(v))


@register("locus_topk_gaps", """
SELECT sample_id, chr, start_bp, rank, match_sample, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match_sample) AS rank
  FROM gap_pairs WHERE chr = rchr AND start_bp = rstart) WHERE rank <= 5""", ["gap_pairs"])
def locus_topk_gaps(fx):
    return S.locus_matches(_gaps(fx, "query"), _gaps(fx, "ref"), 5).select(
        "sample_id", "chr", "start_bp", F.col("rank").cast("bigint").alias("rank"), "match_sample", r6("score"))


@register("cell_type_gaps", """
SELECT sample_id, id, cell_type, round(max(score), 6) AS score FROM gap_pairs GROUP BY 1, 2, 3""", ["gap_pairs"])
def cell_type_gaps(fx):
    return S.cell_type_scores(_gaps(fx, "query"), _gaps(fx, "ref")).select("sample_id", "id", "cell_type", r6("score"))


@register("level1_vote", """
SELECT sample_id, top_cell_type, votes, round(fraction, 6) AS fraction FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, top_cell_type) AS rn FROM (
    SELECT sample_id, top_cell_type, count(*) AS votes,
      count(*)*1.0E0/sum(count(*)) OVER (PARTITION BY sample_id) AS fraction
    FROM win GROUP BY 1,2)) WHERE rn = 1""", ["win"])
def level1_vote(fx):
    w = _windows(fx).where("has_match")
    return R.majority_vote(w).select("sample_id", "top_cell_type", "votes", r6("fraction"))


@register("vote_distribution", """
SELECT sample_id, top_cell_type, count(*) AS votes,
  round(count(*)*1.0E0/sum(count(*)) OVER (PARTITION BY sample_id), 6) AS fraction
FROM win GROUP BY 1,2""", ["win"])
def vote_distribution(fx):
    return R.vote_distribution(_windows(fx).where("has_match")).select(
        "sample_id", "top_cell_type", "votes", r6("fraction"))


@register("sample_vote", """
SELECT sample_id, top_sample, count(*) AS votes,
  round(count(*)*1.0E0/sum(count(*)) OVER (PARTITION BY sample_id), 6) AS fraction
FROM win GROUP BY 1,2""", ["win"])
def sample_vote(fx):
    return R.vote_distribution(_windows(fx).where("has_match"), "top_sample").select(
        "sample_id", "top_sample", "votes", r6("fraction"))


_CHROM = """
SELECT sample_id, chr, round(avg(similarity), 6) AS mean_similarity, count(*) AS n_windows,
  round(min(similarity), 6) AS min_similarity, round(max(similarity), 6) AS max_similarity,
  (SELECT x.top_cell_type FROM (SELECT top_cell_type, count(*) AS n FROM win i
     WHERE i.sample_id = win.sample_id AND i.chr = win.chr GROUP BY 1) x
   ORDER BY x.n DESC, x.top_cell_type LIMIT 1) AS top_cell_type,
  avg(similarity) < 0.3 AS divergent,
  CASE WHEN avg(similarity) > 0.7 THEN 'STRUCTURALLY_SIMILAR' WHEN avg(similarity) > 0.3
       THEN 'PARTIALLY_SIMILAR' ELSE 'DIVERGENT' END AS status
FROM win GROUP BY sample_id, chr"""


@register("level2_chrom", _CHROM, ["win"])
def level2_chrom(fx):
    return R.chromosome_summary(_windows(fx)).select(
        "sample_id", "chr", r6("mean_similarity"), "n_windows", r6("min_similarity"), r6("max_similarity"),
        "top_cell_type", "divergent", "status")


@register("level4_divergent", """
SELECT sample_id, chr, start_bp, end_bp, round(similarity, 6) AS similarity, top_sample, top_cell_type, status,
  row_number() OVER (PARTITION BY sample_id ORDER BY similarity, chr, start_bp) AS rank
FROM win WHERE similarity < 0.3""", ["win"])
def level4_divergent(fx):
    return R.divergent_windows(_windows(fx)).select(
        "sample_id", "chr", "start_bp", "end_bp", r6("similarity"), "top_sample", "top_cell_type", "status",
        F.col("rank").cast("bigint").alias("rank"))


@register("level_rollup", """
SELECT sample_id, chr, start_bp, round(avg(similarity), 6) AS mean_similarity, count(*) AS n_windows
FROM win GROUP BY ROLLUP (sample_id, chr, start_bp) HAVING sample_id IS NOT NULL""", ["win"])
def level_rollup(fx):
    return R.chromosome_locus_rollup(_windows(fx)).select(
        "sample_id", "chr", "start_bp", r6("mean_similarity"), "n_windows")


# references of chr5 are withheld so that some windows have none at their locus
define("ref_held", "SELECT * FROM members WHERE role = 'ref' AND NOT (chr = 'chr5' AND start_bp < 25600000)", ["members"])
define("centroid_dims", """
SELECT chr, start_bp, end_bp, p, avg(v[p]) AS x FROM ref_held, (SELECT unnest(range(1,65)) AS p) GROUP BY ALL""",
       ["ref_held"])
define("centroid", """
SELECT chr, start_bp, end_bp, list(x ORDER BY p) AS c FROM centroid_dims GROUP BY ALL""", ["centroid_dims"])
define("heldout", """
SELECT q.sample_id, q.chr, q.start_bp, b.similarity, b.top_sample, b.top_cell_type,
  CASE WHEN b.similarity < 0.3 THEN 'STRUCTURALLY_DIFFERENT' WHEN b.similarity < 0.7 THEN 'PARTIALLY_SIMILAR'
       ELSE 'STRUCTURALLY_SIMILAR' END AS status
FROM members q JOIN (
  SELECT q.id, list_dot_product(q.v, r.v)/(q.len*r.len) AS similarity, r.sample_id AS top_sample,
    r.cell_type AS top_cell_type,
    row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, r.v)/(q.len*r.len) DESC, r.sample_id) AS rn
  FROM members q JOIN ref_held r ON q.chr = r.chr AND q.start_bp = r.start_bp WHERE q.role = 'query') b
  ON b.id = q.id AND b.rn = 1
UNION ALL
SELECT q.sample_id, q.chr, q.start_bp,
  max(list_dot_product(q.v, c.c)/(q.len*(sqrt(list_dot_product(c.c, c.c))+1e-8))),
  'NO_REFERENCE_LOCUS', 'UNKNOWN', 'NO_REFERENCE'
FROM members q, centroid c
WHERE q.role = 'query' AND NOT EXISTS (SELECT 1 FROM ref_held r WHERE r.chr = q.chr AND r.start_bp = q.start_bp)
GROUP BY 1,2,3""", ["ref_held", "centroid"])


def _heldout(fx):
    from ..operators.tables import locus_centroids
    refs = fx.members("ref").where("NOT (chr = 'chr5' AND start_bp < 25600000)")
    return S.heldout_windows(fx.members("query"), refs, locus_centroids(refs))


@register("no_reference_windows", """
SELECT sample_id, chr, start_bp, round(similarity, 6) AS similarity, top_sample, top_cell_type, status
FROM heldout""", ["heldout"])
def no_reference_windows(fx):
    return _heldout(fx).select("sample_id", "chr", "start_bp", r6("similarity"), "top_sample", "top_cell_type", "status")


@register("status_summary", """
SELECT sample_id, count(*) FILTER (status = 'STRUCTURALLY_DIFFERENT') AS n_divergent,
  count(*) FILTER (status = 'PARTIALLY_SIMILAR') AS n_partial,
  count(*) FILTER (status = 'STRUCTURALLY_SIMILAR') AS n_similar,
  round(avg(similarity), 6) AS mean_similarity, count(*) AS n_windows
FROM heldout WHERE status <> 'NO_REFERENCE' GROUP BY 1""", ["heldout"])
def status_summary(fx):
    return R.status_summary(_heldout(fx)).select(
        "sample_id", "n_divergent", "n_partial", "n_similar", r6("mean_similarity"), "n_windows")


define("centroid_all", """
SELECT chr, start_bp, end_bp, list(x ORDER BY p) AS c FROM (
  SELECT chr, start_bp, end_bp, p, avg(v[p]) AS x FROM members, (SELECT unnest(range(1,65)) AS p) WHERE role = 'ref' GROUP BY ALL)
GROUP BY ALL""", ["members"])


@register("centroid_search", """
SELECT sample_id, chr, start_bp, rank, ref_chr, ref_start_bp, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id, chr, start_bp ORDER BY score DESC, locus) AS rank FROM (
    SELECT q.sample_id, q.chr, q.start_bp, c.chr AS ref_chr, c.start_bp AS ref_start_bp,
      concat(c.chr, ':', c.start_bp, '-', c.end_bp) AS locus,
      list_dot_product(q.v, c.c)/(q.len*(sqrt(list_dot_product(c.c, c.c))+1e-8)) AS score
    FROM members q, centroid_all c WHERE q.role = 'query')) WHERE rank <= 5""", ["centroid_all"])
def centroid_search(fx):
    from ..operators.tables import locus_centroids
    return S.centroid_matches(fx.members("query"), locus_centroids(fx.members("ref")), 5).select(
        "sample_id", "chr", "start_bp", F.col("rank").cast("bigint").alias("rank"), "ref_chr", "ref_start_bp",
        r6("score"))


@register("cell_type_similarity", """
SELECT sample_id, cell_type, round(similarity, 6) AS similarity, n_tiles, rank FROM type_mean""", ["type_mean"])
def cell_type_similarity(fx):
    s = S.cell_type_scores(fx.members("query"), fx.members("ref"))
    return R.cell_type_similarity(s).select("sample_id", "cell_type", r6("similarity"), "n_tiles",
                                            F.col("rank").cast("bigint").alias("rank"))


@register("loci_won", "SELECT sample_id, cell_type, loci_won FROM type_mean", ["type_mean"])
def loci_won(fx):
    s = S.cell_type_scores(fx.members("query"), fx.members("ref"))
    return R.cell_type_similarity(s).select("sample_id", "cell_type", "loci_won")


@register("divergent_z", """
SELECT sample_id, cell_type, id, concat(chr, ':', CAST(start_bp // 1000000 AS BIGINT), '.0M-',
    CAST(end_bp // 1000000 AS BIGINT), '.0M') AS locus, round(score, 6) AS similarity,
  round((score - m)/s, 6) + 0.0E0 AS z_score, rank FROM (
  SELECT b.*, avg(b.score) OVER (PARTITION BY b.sample_id) AS m,
    stddev_pop(b.score) OVER (PARTITION BY b.sample_id) + 1e-8 AS s,
    row_number() OVER (PARTITION BY b.sample_id ORDER BY b.score, b.id) AS rank
  FROM type_best b JOIN type_mean t ON b.sample_id = t.sample_id AND b.cell_type = t.cell_type AND t.rank = 1)""", ["type_mean"])
def divergent_z(fx):
    return collection.divergent_from_top(fx.members("query"), fx.members("ref")).select(
        "sample_id", "cell_type", "id", "locus", F.round("score", 6).alias("similarity"), r6("z_score"),
        F.col("rank").cast("bigint").alias("rank"))


define("pair_ab", """
SELECT a.id, a.chr, a.start_bp, a.end_bp, list_dot_product(a.v, b.v)/(a.len*b.len) AS score
FROM members a, members b WHERE a.sample_id = 'CT0_rep1' AND b.sample_id = 'CT1_rep1'""", ["members"])
define("pair_best", "SELECT id, chr, start_bp, end_bp, max(score) AS best FROM pair_ab GROUP BY ALL", ["pair_ab"])


def _pair(fx):
    f = fx.fingerprints
    return f.where("sample_id = 'CT0_rep1'"), f.where("sample_id = 'CT1_rep1'")


@register("compare_pair", """
SELECT round(m, 6) AS mean_similarity, round(x, 6) AS max_similarity, round(f, 6) AS fraction_high,
  CASE WHEN m > 0.95 THEN 'STRUCTURALLY IDENTICAL' WHEN m > 0.88 THEN 'VERY SIMILAR'
       WHEN m > 0.75 THEN 'SIMILAR' ELSE 'DIFFERENT' END AS verdict
FROM (SELECT avg(score) AS m, max(score) AS x FROM pair_ab),
     (SELECT avg(CASE WHEN best > 0.85 THEN 1.0E0 ELSE 0.0E0 END) AS f FROM pair_best)""", ["pair_best"])
def compare_pair(fx):
    return collection.compare_samples(*_pair(fx)).select(
        r6("mean_similarity"), r6("max_similarity"), r6("fraction_high"), "verdict")


@register("compare_by_chrom", """
SELECT chr, round(avg(best), 6) AS mean_similarity, count(*) AS n_tiles FROM pair_best GROUP BY 1""", ["pair_best"])
def compare_by_chrom(fx):
    return collection.compare_by_chromosome(*_pair(fx)).select("chr", r6("mean_similarity"), "n_tiles")


@register("compare_divergent", """
SELECT chr, start_bp, round(best, 6) AS similarity, round((best - m)/s, 6) + 0.0E0 AS z_score FROM (
  SELECT *, avg(best) OVER () AS m, stddev_pop(best) OVER () + 1e-8 AS s FROM pair_best)""", ["pair_best"])
def compare_divergent(fx):
    return collection.compare_divergent(*_pair(fx)).select(
        "chr", "start_bp", F.round("score", 6).alias("similarity"), r6("z_score"))


@register("accuracy_test", """
SELECT count(*) AS total, count(*) FILTER (t.cell_type = s.cell_type) AS correct,
  round(avg(CASE WHEN t.cell_type = s.cell_type THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy,
  avg(CASE WHEN t.cell_type = s.cell_type THEN 1.0E0 ELSE 0.0E0 END) > 0.7 AS passed
FROM type_mean t JOIN samples s USING (sample_id) WHERE t.rank = 1""", ["type_mean"])
def accuracy_test(fx):
    truth = fx.samples.select("sample_id", F.col("cell_type").alias("true_type"))
    return collection.accuracy_test(fx.members("query"), fx.members("ref"), truth).select(
        "total", "correct", r6("accuracy"), "passed")


# shuffle k takes the positions in the order of their keyed hashes; the mean reference is linear in the references
define("shuffles", """
SELECT k, list(i ORDER BY md5(concat('42:', k, ':', i))) AS p
FROM (SELECT unnest(range(0, 500)) AS k), (SELECT unnest(range(0, 64)) AS i) GROUP BY k""")
define("mean_refs", """
SELECT chr, start_bp, list(x ORDER BY p) AS m FROM (
  SELECT chr, start_bp, p, avg(v[p]/len) AS x FROM members, (SELECT unnest(range(1, 65)) AS p) WHERE role = 'ref' GROUP BY ALL)
GROUP BY ALL""", ["members"])


@register("permutation_p", """
SELECT sample_id, chr, start_bp, round(observed, 6) + 0.0E0 AS observed, round((hits + 1)/501.0E0, 6) AS p_value FROM (
  SELECT q.sample_id, q.chr, q.start_bp, any_value(list_dot_product(q.v, r.m)/q.len) AS observed,
    count(*) FILTER (list_dot_product(list_transform(s.p, lambda i: q.v[i + 1]), r.m)/q.len >= list_dot_product(q.v, r.m)/q.len) AS hits
  FROM members q JOIN mean_refs r USING (chr, start_bp), shuffles s WHERE q.role = 'query' GROUP BY 1, 2, 3)""",
          ["members", "mean_refs", "shuffles"])
def permutation_p(fx):
    return S.permutation_pvalues(fx.members("query"), fx.members("ref")).select(
        "sample_id", "chr", "start_bp", r6("observed"), r6("p_value"))


@register("observed_mean_cosine", """
SELECT sample_id, chr, start_bp, round(avg(score), 6) + 0.0E0 AS observed FROM locus_pairs GROUP BY 1,2,3""",
          ["locus_pairs"])
def observed_mean_cosine(fx):
    return S.permutation_pvalues(fx.members("query"), fx.members("ref"), n_perm=1).select(
        "sample_id", "chr", "start_bp", r6("observed"))


@register("tile_positions", """
SELECT sample_id, id, row_number() OVER (PARTITION BY sample_id ORDER BY chr, start_bp) AS by_name,
  row_number() OVER (PARTITION BY sample_id ORDER BY CAST(substr(chr, 4) AS INTEGER), start_bp) AS by_list
FROM fingerprints""", ["fingerprints"])
def tile_positions(fx):
    by_name = S.tile_positions(fx.fingerprints).withColumnRenamed("position", "by_name")
    return S.tile_positions(by_name, listed=True).select(
        "sample_id", "id", F.col("by_name").cast("bigint").alias("by_name"),
        F.col("position").cast("bigint").alias("by_list"))


@register("present_chromosomes", """
SELECT DISTINCT chr AS chrom, CAST(substr(chr, 4) AS INTEGER) AS position FROM fingerprints""", ["fingerprints"])
def present_chromosomes(fx):
    from ..operators.contacts import present_chromosomes as present
    return present(fx.fingerprints, "chr").select("chrom", F.col("position").cast("int").alias("position"))


@register("reference_set", """
SELECT f.id, s.cell_type FROM fingerprints f JOIN samples s USING (sample_id)""", ["fingerprints", "samples"])
def reference_set(fx):
    return collection.reference_set(fx.fingerprints).select("id", "cell_type")


@register("display_text", """
SELECT sample_id, chr, start_bp,
  CASE WHEN similarity >= 0.90 THEN 'VERY HIGH ★★★' WHEN similarity >= 0.80 THEN 'HIGH     ★★☆'
       WHEN similarity >= 0.65 THEN 'MEDIUM   ★☆☆' ELSE 'LOW      ☆☆☆' END AS badge,
  concat(repeat('█', CAST(round_even(similarity*20, 0) AS INTEGER)),
         repeat('░', 20 - CAST(round_even(similarity*20, 0) AS INTEGER))) AS bar,
  concat(chr, ':', start_bp, '-', end_bp) AS locus
FROM win""", ["win"])
def display_text(fx):
    s = F.col("similarity")
    return _windows(fx).select("sample_id", "chr", "start_bp", L.confidence_badge(s).alias("badge"),
                               L.bar(s).alias("bar"), L.locus(F.col("chr"), F.col("start_bp"), F.col("end_bp")).alias("locus"))


_BADGE = """CASE WHEN similarity >= 0.90 THEN 'VERY HIGH ★★★' WHEN similarity >= 0.80 THEN 'HIGH     ★★☆'
       WHEN similarity >= 0.65 THEN 'MEDIUM   ★☆☆' ELSE 'LOW      ☆☆☆' END"""


@register("collection_report", f"""
SELECT sample_id, n_tiles, CAST(rank AS INTEGER) AS rank, cell_type, round(similarity, 6) AS similarity,
  {_BADGE} AS confidence, loci_won FROM type_mean""", ["type_mean"])
def collection_report(fx):
    """The nested report of every query sample, its ranked matches unnested."""
    out = collection.query_report(fx.members("query"), fx.members("ref"))
    m = out.select("sample_id", "n_tiles", F.inline("top_matches"))
    return m.select("sample_id", "n_tiles", "rank", "cell_type", r6("similarity"), "confidence", "loci_won")


define("vote1", """
SELECT sample_id, top_cell_type, n AS votes, n*1.0E0/t AS fraction FROM (
  SELECT sample_id, top_cell_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY sample_id) AS t,
    row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, top_cell_type) AS rn
  FROM win GROUP BY 1,2) WHERE rn = 1""", ["win"])


@register("locus_query_report", f"""
SELECT c.sample_id, (SELECT count(*) FROM win w WHERE w.sample_id = c.sample_id) AS n_windows,
  v.top_cell_type AS level1_cell_type, round(v.fraction, 6) AS level1_fraction,
  (SELECT count(*) FROM win w WHERE w.sample_id = c.sample_id AND w.similarity < 0.3 ) AS n_divergent,
  c.chr, c.mean_similarity, c.n_windows AS n_in_chrom, c.divergent
FROM ({_CHROM}) c JOIN vote1 v ON v.sample_id = c.sample_id""", ["win", "vote1"])
def locus_query_report(fx):
    """The nested four-level report of every query sample, its chromosome level unnested."""
    out = locus_report.four_level_report(fx.members("query"), fx.members("ref"), n_divergent=None)
    c = out.select("sample_id", "n_windows", F.col("level1.cell_type").alias("level1_cell_type"),
                   F.round("level1.fraction", 6).alias("level1_fraction"),
                   F.coalesce(F.size("level4"), F.lit(0)).cast("long").alias("n_divergent"),
                   F.explode("level2").alias("c"))
    return c.select("sample_id", "n_windows", "level1_cell_type", "level1_fraction", "n_divergent", "c.chr",
                    (F.round("c.mean_similarity", 6) + F.lit(0.0)).alias("mean_similarity"),
                    F.col("c.n_windows").alias("n_in_chrom"), "c.divergent")


define("hvote", """
SELECT sample_id, top_cell_type, n, t, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, top_cell_type) AS rn FROM (
  SELECT sample_id, top_cell_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY sample_id) AS t
  FROM heldout WHERE status <> 'NO_REFERENCE' GROUP BY 1,2)""", ["heldout"])


@register("heldout_report", """
SELECT h.sample_id, count(*) AS n_windows_total, count(*) FILTER (h.status <> 'NO_REFERENCE') AS n_windows,
  any_value(v.top_cell_type) AS cell_type, round(any_value(v.n*1.0E0/v.t), 6) AS fraction,
  (SELECT count(*) FROM hvote x WHERE x.sample_id = h.sample_id) AS n_candidates,
  count(*) FILTER (h.status = 'STRUCTURALLY_DIFFERENT') AS n_divergent
FROM heldout h JOIN hvote v ON v.sample_id = h.sample_id AND v.rn = 1 GROUP BY 1""", ["heldout", "hvote"])
def heldout_report(fx):
    from ..operators.tables import locus_centroids
    refs = fx.members("ref").where("NOT (chr = 'chr5' AND start_bp < 25600000)")
    out = locus_report.heldout_report(fx.members("query"), refs, locus_centroids(refs))
    return out.select("sample_id", "n_windows_total", "n_windows", F.col("level1.cell_type").alias("cell_type"),
                      F.round("level1.fraction", 6).alias("fraction"),
                      F.size(F.map_keys("vote_distribution")).cast("long").alias("n_candidates"), "n_divergent")


# element counts of a report: the query sample's cell against its first-ranked cell type
define("profile", """
SELECT sample_id, category, count(*) AS n FROM ccre_clean WHERE chrom IN ('chr1', 'chr2', 'chr3', 'chr4', 'chr5') GROUP BY 1, 2""",
       ["ccre_clean"])
_ARROW = "CASE WHEN d > 0 THEN concat('▲ +', d) WHEN d < 0 THEN concat('▼ ', d) ELSE '  =' END"


@register("collection_report_regulatory", """
SELECT t.sample_id, c.category, coalesce(a.n, 0) AS n_query, coalesce(b.n, 0) AS n_ref FROM type_mean t
JOIN samples s USING (sample_id) CROSS JOIN (SELECT DISTINCT category FROM profile) c
LEFT JOIN profile a ON a.sample_id = s.cell_type AND a.category = c.category
LEFT JOIN profile b ON b.sample_id = t.cell_type AND b.category = c.category
WHERE t.rank = 1 AND (a.n > 0 OR b.n > 0)""", ["type_mean", "samples", "profile"])
def collection_report_regulatory(fx):
    from .annotation import _ccre
    out = collection.query_report(fx.members("query"), fx.members("ref"), ccre=_ccre(fx))
    return out.select("sample_id", F.inline("regulatory")).select("sample_id", "category", "n_query", "n_ref")


@register("collection_report_loci", f"""
SELECT sample_id, locus, round(score, 6) AS similarity, round((score - m)/s, 6) + 0.0E0 AS z_score, rank, round(top_similarity, 6) AS top_similarity,
  (SELECT count(DISTINCT cell_type) FROM samples WHERE role = 'ref') AS n_reference FROM (
  SELECT b.*, concat(chr, ':', CAST(start_bp // 1000000 AS BIGINT), '.0M-', CAST(end_bp // 1000000 AS BIGINT), '.0M') AS locus,
    t.similarity AS top_similarity, avg(b.score) OVER (PARTITION BY b.sample_id) AS m,
    stddev_pop(b.score) OVER (PARTITION BY b.sample_id) + 1e-8 AS s,
    row_number() OVER (PARTITION BY b.sample_id ORDER BY b.score, b.id) AS rank
  FROM type_best b JOIN type_mean t ON b.sample_id = t.sample_id AND b.cell_type = t.cell_type AND t.rank = 1)""", ["type_mean", "samples"])
def collection_report_loci(fx):
    """The divergent loci and the summary of the nested report."""
    out = collection.query_report(fx.members("query"), fx.members("ref"))
    d = out.select("sample_id", "summary", F.inline("divergent_loci"))
    return d.select("sample_id", "locus", r6("similarity"), r6("z_score"), F.col("rank").cast("bigint").alias("rank"),
                    F.round("summary.top_similarity", 6).alias("top_similarity"), F.col("summary.n_reference").alias("n_reference"))


def _compare(fx):
    from .annotation import _ccre
    return collection.compare_report(*_pair(fx), _ccre(fx), "CT0", "CT1")


@register("compare_report", """
SELECT c.chr, c.mean_similarity AS chr_similarity, c.n_tiles, p.mean_similarity, p.max_similarity, p.fraction_high, p.verdict,
  (SELECT count(*) FROM pair_best) AS n_loci,
  (SELECT sum(n) FROM profile WHERE sample_id = 'CT0')::BIGINT AS total_a, (SELECT sum(n) FROM profile WHERE sample_id = 'CT1')::BIGINT AS total_b
FROM ({}) c, ({}) p""".format(ORACLES["compare_by_chrom"][0], ORACLES["compare_pair"][0]), ["pair_best", "profile"])
def compare_report(fx):
    """The nested comparison, its chromosomes unnested."""
    out = _compare(fx)
    c = out.select("*", F.explode("by_chromosome").alias("c"))
    return c.select("c.chr", (F.round("c.mean_similarity", 6) + F.lit(0.0)).alias("chr_similarity"), F.col("c.n_tiles").alias("n_tiles"),
                    r6("mean_similarity"), r6("max_similarity"), r6("fraction_high"), "verdict",
                    F.size("divergent_loci").cast("long").alias("n_loci"), "total_a", "total_b")


@register("compare_report_loci", """
SELECT chr, start_bp, round(best, 6) AS similarity, round((best - m)/s, 6) + 0.0E0 AS z_score,
  row_number() OVER (ORDER BY best, id) AS rank FROM (
  SELECT *, avg(best) OVER () AS m, stddev_pop(best) OVER () + 1e-8 AS s FROM pair_best)""", ["pair_best"])
def compare_report_loci(fx):
    d = _compare(fx).select(F.inline("divergent_loci"))
    return d.select("chr", "start_bp", r6("similarity"), r6("z_score"), F.col("rank").cast("bigint").alias("rank"))


@register("compare_report_regulatory", """
SELECT c.category, coalesce(a.n, 0) AS n_query, coalesce(b.n, 0) AS n_ref FROM (SELECT DISTINCT category FROM profile) c
LEFT JOIN profile a ON a.sample_id = 'CT0' AND a.category = c.category
LEFT JOIN profile b ON b.sample_id = 'CT1' AND b.category = c.category WHERE a.n > 0 OR b.n > 0""", ["profile"])
def compare_report_regulatory(fx):
    return _compare(fx).select(F.inline("regulatory")).select("category", "n_query", "n_ref")


# boundary and compartment profiles for the fixture: the halves of the vector
def _with_profiles(members):
    return (members.withColumn("boundary", F.slice("fingerprint", 1, 32)).withColumn("compartment", F.slice("fingerprint", 33, 32)))


def _pearson_sql(x, y):
    return f"""(SELECT sum((x - mx)*(y - my))/(sqrt(sum(pow(x - mx, 2))*sum(pow(y - my, 2))) + 1e-8)
    FROM (SELECT unnest({x}) AS x, unnest({y}) AS y, list_avg({x}) AS mx, list_avg({y}) AS my))"""


def _report(fx):
    from .annotation import _ccre
    return locus_report.four_level_report(_with_profiles(fx.members("query")), _with_profiles(fx.members("ref")),
                                          ccre=_ccre(fx), cell=N.cell_name)


define("lost_loci", """
SELECT w.*, row_number() OVER (PARTITION BY w.sample_id ORDER BY similarity, w.chr, w.start_bp) AS rank,
  s.cell_type AS own_cell, t.cell_type AS other_cell, q.v AS qv, r.v AS rv
FROM win w JOIN samples s ON s.sample_id = w.sample_id JOIN samples t ON t.sample_id = w.top_sample
JOIN members q ON q.sample_id = w.sample_id AND q.chr = w.chr AND q.start_bp = w.start_bp
JOIN members r ON r.sample_id = w.top_sample AND r.chr = w.chr AND r.start_bp = w.start_bp
WHERE similarity < 0.3""", ["win", "samples", "members"])


@register("locus_report_divergent", f"""
SELECT sample_id, rank, chr, start_bp, round(similarity, 6) AS similarity, top_sample, status, p_value,
  round({_pearson_sql("qv[1:32]", "rv[1:32]")}, 6) + 0.0E0 AS boundary_concordance,
  round({_pearson_sql("qv[33:64]", "rv[33:64]")}, 6) + 0.0E0 AS compartment_concordance
FROM lost_loci LEFT JOIN ({ORACLES["permutation_p"][0]}) p USING (sample_id, chr, start_bp)""",
          ["lost_loci", *ORACLES["permutation_p"][1]])
def locus_report_divergent(fx):
    """Level 4 of the nested report with p-value and concordances."""
    d = _report(fx).select("sample_id", F.inline("level4"))
    return d.select("sample_id", F.col("rank").cast("bigint").alias("rank"), "chr", "start_bp", r6("similarity"), "top_sample",
                    "status", r6("p_value"), r6("boundary_concordance"), r6("compartment_concordance"))


_NAMES = C.CCRE_CATEGORIES + C.ANNOTATION_DERIVED


@register("locus_report_annotation", f"""
SELECT l.sample_id, l.chr, l.start_bp, CAST(k - 1 AS INTEGER) AS feature,
  round(CAST(CAST([{", ".join(f'a."{c}"' for c in _NAMES)}][k] AS FLOAT) AS DOUBLE), 4) + 0.0E0 AS value,
  array_to_string(list_filter([{", ".join(f"""CASE WHEN abs(a."{c}" - b."{c}") >= 10 THEN concat('{c}: ', printf('%+.0f', a."{c}" - b."{c}"),
    CASE WHEN a."{c}" > b."{c}" THEN ' (more in query)' ELSE ' (fewer in query)' END) END""" for c in C.CCRE_CATEGORIES)}],
    lambda x: x IS NOT NULL), '; ') AS lines
FROM lost_loci l JOIN annot a ON a.sample_id = l.own_cell AND a.chrom = l.chr AND a.win_start = l.start_bp
JOIN annot b ON b.sample_id = l.other_cell AND b.chrom = l.chr AND b.win_start = l.start_bp, (SELECT unnest(range(1, 17)) AS k)""",
          ["lost_loci", "annot"])
def locus_report_annotation(fx):
    """The 16 annotation values and the lines of change of every divergent locus."""
    d = _report(fx).select("sample_id", F.inline("level4"))
    v = d.select("sample_id", "chr", "start_bp", F.array_join("ccre_diff", "; ").alias("lines"),
                 F.posexplode("ccre_annot_query").alias("feature", "v"))
    return v.select("sample_id", "chr", "start_bp", "feature",
                    (F.round(F.col("v").cast("double"), 4) + F.lit(0.0)).alias("value"), "lines")
