"""Names, replicates, registries, store maintenance, splits."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import names as N
from ..operators import annotation as A
from ..operators import replicates as R
from ..operators import similarity as S
from ..operators import tables as T
from ..plans import collection, regulatory
from .base import define, r6, registry

QUERIES, ORACLES, register = registry()

# file stems made from the vectors: eight shapes, the number kept in the name
_SHAPES = [
    ("concat('GM', n, '_4DNFI2A4OBS9')", "concat('GM', n)", "concat('GM', n, '_4DNFI2A4OBS9')"),
    ("concat('HCT', n, '_auxin2h_4DNFI3PNAYBK')", "concat('HCT', n)", "concat('HCT', n, '_auxin2h_4DNFI3PNAYBK')"),
    ("concat('dTAG-N', n, '_hTERT-RPE-1_-_clone_A2_ENCFF123')", "concat('dTAG-N', n, '_hTERT-RPE-1')",
     "concat('dTAG-N', n, '_hTERT-RPE-1_-_clone_A2_ENCFF123')"),
    ("concat('foreskin', n, '_fibroblast_4DNFIQJQY7PW')", "concat('foreskin', n, '_fibroblast')",
     "concat('foreskin', n, '_fibroblast_4DNFIQJQY7PW')"),
    ("concat('K', n, '_rep1')", "concat('K', n)", "concat('K', n)"),
    ("concat('IMR-', n, '_r2')", "concat('IMR-', n)", "concat('IMR-', n)"),
    ("concat('HeLa-S', n, '_batch_A')", "concat('HeLa-S', n, '_batch_A')", "concat('HeLa-S', n)"),
    ("concat('C', n, 'x.3')", "concat('C', n, 'x.3')", "concat('C', n, 'x')"),
]


def _case(col):
    return "CASE n % 8 " + " ".join(f"WHEN {i} THEN {s[col]}" for i, s in enumerate(_SHAPES)) + " END"


define("stems", f"SELECT n, {_case(0)} AS stem FROM (SELECT vec_id AS n FROM embeddings)")


def _stems(fx):
    return fx.table("embeddings").select(F.col("vec_id").alias("n")).select("n", F.expr(_case(0)).alias("stem"))


@register("canonical_names", f"SELECT n, stem, {_case(1)} AS cell FROM stems", ["stems"])
def canonical_names(fx):
    return _stems(fx).select("n", "stem", N.cell_name(F.col("stem")).alias("cell"))


@register("replicate_groups", f"SELECT n, stem, {_case(2)} AS grp FROM stems", ["stems"])
def replicate_groups(fx):
    return _stems(fx).select("n", "stem", N.replicate_group(F.col("stem")).alias("grp"))


@register("accession_strip", r"""
SELECT n, stem, regexp_replace(stem, '(?i)[_.]?(4DNF[A-Z0-9]+|ENCFF[A-Z0-9]+)$', '') AS sample_id FROM stems""", ["stems"])
def accession_strip(fx):
    return _stems(fx).select("n", "stem", N.sample_name(F.col("stem")).alias("sample_id"))


define("grp_matches", """
SELECT *, regexp_replace(match_sample, '_rep\\d+$', '') AS grp FROM locus_ranked WHERE rank <= 5""", ["locus_ranked"])


def _matches(fx):
    return S.locus_matches(fx.members("query"), fx.members("ref"), 5)


@register("group_match", """
SELECT sample_id, chr, start_bp, match_sample, grp, round(avg(score) OVER w, 4) AS group_sim_mean,
  round(stddev_pop(score) OVER w, 4) + 0.0E0 AS group_sim_std, count(*) OVER w AS n_replicates,
  CASE WHEN count(*) OVER w = 1 THEN 'single_sample' WHEN stddev_pop(score) OVER w < 0.05 THEN 'high'
       WHEN stddev_pop(score) OVER w < 0.15 THEN 'medium' ELSE 'low' END AS confidence
FROM grp_matches WINDOW w AS (PARTITION BY sample_id, chr, start_bp, grp)""", ["grp_matches"])
def group_match(fx):
    return R.group_matches(_matches(fx), S.WINDOW_KEY).select(
        *S.WINDOW_KEY, "match_sample", "grp", "group_sim_mean", "group_sim_std", "n_replicates", "confidence")


@register("best_group", """
SELECT sample_id, chr, start_bp, grp, round(m, 4) AS mean_similarity,
  CASE WHEN n = 1 OR s < 0.05 THEN 'high' WHEN s < 0.15 THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id, chr, start_bp ORDER BY m DESC, grp) AS rn FROM (
    SELECT sample_id, chr, start_bp, grp, avg(score) AS m, stddev_pop(score) AS s, count(*) AS n
    FROM grp_matches GROUP BY 1,2,3,4)) WHERE rn = 1""", ["grp_matches"])
def best_group(fx):
    return R.best_group(_matches(fx), S.WINDOW_KEY)


@register("replicate_confidence", """
SELECT grp, n_replicates, round(coalesce(m, 1), 4) + 0.0E0 AS mean_cosine_similarity,
  round(coalesce(s, 0), 4) + 0.0E0 AS std_cosine_similarity,
  CASE WHEN m IS NULL THEN 'single_sample' WHEN m > 0.8 THEN 'high' WHEN m > 0.5 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT cell_type AS grp, count(DISTINCT sample_id) AS n_replicates FROM members GROUP BY 1) LEFT JOIN (
  SELECT grp, avg(sim) AS m, stddev_pop(sim) AS s FROM (
    SELECT a.cell_type AS grp, a.sample_id AS x, b.sample_id AS y, avg(list_dot_product(a.v, b.v)/(a.len*b.len)) AS sim
    FROM members a JOIN members b ON a.cell_type = b.cell_type AND a.chr = b.chr AND a.start_bp = b.start_bp
      AND a.sample_id < b.sample_id GROUP BY 1,2,3) GROUP BY 1) USING (grp)""", ["members"])
def replicate_confidence(fx):
    out = R.replicate_consistency(fx.fingerprints)
    return out.select("grp", "n_replicates", (F.col("mean_cosine_similarity") + 0.0).alias("mean_cosine_similarity"),
                      (F.col("std_cosine_similarity") + 0.0).alias("std_cosine_similarity"), "confidence")


@register("group_avg_fp", """
SELECT cell_type AS grp, chr, start_bp, CAST(p.p - 1 AS INTEGER) AS dim, round(avg(v[p.p]), 6) + 0.0E0 AS v,
  count(*) AS n_samples FROM members CROSS JOIN (SELECT unnest(range(1, 65)) AS p) p GROUP BY 1,2,3, p.p""", ["members"])
def group_avg_fp(fx):
    out = T.group_mean_fingerprints(R.with_group(fx.fingerprints), "grp")
    return (out.select("grp", "chr", "start_bp", "n_samples", F.posexplode("fingerprint").alias("dim", "v"))
            .select("grp", "chr", "start_bp", "dim", r6("v"), "n_samples"))


@register("group_members", """
SELECT cell_type AS grp, string_agg(sample_id, ',' ORDER BY sample_id) AS members, count(*) AS n_members
FROM samples GROUP BY 1""", ["samples"])
def group_members(fx):
    return R.group_members(fx.samples).select("grp", F.array_join("members", ",").alias("members"), "n_members")


@register("largest_groups", """
SELECT cell_type, count(*) AS n_files FROM samples GROUP BY 1 HAVING count(*) > 1""", ["samples"])
def largest_groups(fx):
    return R.largest_groups(fx.samples, "cell_type")


# contact files exist for samples whose number is not 4, annotations for CT0..CT4 and CT1_rep2, files for CT0..CT3
define("reg", """
SELECT s.sample_id, s.cell_type AS grp, concat(s.sample_id, '.mcool') AS file,
  s.sample_id NOT LIKE '%4' AS has_contact,
  CASE WHEN s.sample_id = 'CT1_rep2' THEN 'own.bed.gz' WHEN s.cell_type <= 'CT4' THEN concat(s.cell_type, '.bed.gz') END AS a
FROM samples s""", ["samples"])


def _registry_parts(fx):
    s = fx.samples
    reg = s.select("sample_id", F.concat("sample_id", F.lit(".mcool")).alias("file"), F.lit("bulk_hic").alias("assay"), "tissue")
    have = reg.where(~F.col("sample_id").like("%4")).select(F.concat(F.lit("/data/"), "file").alias("path"))
    cells = s.select(F.col("cell_type").alias("sample_id")).distinct().where("sample_id <= 'CT4'")
    own = s.where("sample_id = 'CT1_rep2'").select("sample_id", F.lit("own.bed.gz").alias("path"))
    ann = cells.select("sample_id", F.concat("sample_id", F.lit(".bed.gz")).alias("path")).unionByName(own)
    files = ann.where("path <= 'CT3.bed.gz'").select("path")
    return reg, have, ann, files, "/data"


def _validated(fx):
    return R.validate_registry(*_registry_parts(fx))


@register("registry_validation", """
SELECT sample_id, grp, concat('/data/', file) AS contact_path, has_contact AS contact_exists, a AS annotation_path,
  coalesce(a <= 'CT3.bed.gz', FALSE) AS annotation_exists, NOT has_contact AS skip,
  CASE WHEN coalesce(a <= 'CT3.bed.gz', FALSE) THEN 'full' ELSE 'structural_only' END AS mode,
  concat_ws(' | ', CASE WHEN NOT has_contact THEN concat('contact file not found: /data/', file, '  — sample will be SKIPPED') END,
    CASE WHEN a > 'CT3.bed.gz' THEN concat('cCRE file not found: ', a, '  — regulatory analysis DISABLED')
         WHEN a IS NULL THEN concat('No cCRE annotation registered for ', sample_id, '  (group: ', grp,
           ')  — regulatory analysis DISABLED') END) AS warnings
FROM reg""", ["reg"])
def registry_validation(fx):
    return _validated(fx).select(
        "sample_id", "grp", "contact_path", "contact_exists", "annotation_path", "annotation_exists", "skip", "mode",
        F.array_join("warnings", " | ").alias("warnings"))


@register("registry_status", """
SELECT count(*) AS n_samples, count(DISTINCT grp) AS n_groups,
  count(*) FILTER (has_contact AND coalesce(a <= 'CT3.bed.gz', FALSE)) AS n_full,
  count(*) FILTER (has_contact AND NOT coalesce(a <= 'CT3.bed.gz', FALSE)) AS n_structural_only,
  count(*) FILTER (NOT has_contact) AS n_skipped FROM reg""", ["reg"])
def registry_status(fx):
    return R.registry_summary(_validated(fx))


@register("registry_report", ORACLES["registry_status"][0], ["reg"])
def registry_report(fx):
    """The report's summary; its rows are those of the validation."""
    return regulatory.registry_report(*_registry_parts(fx))[1]


@register("active_samples", "SELECT sample_id, grp FROM reg WHERE has_contact", ["reg"])
def active_samples(fx):
    return R.active_samples(regulatory.registry_report(*_registry_parts(fx))[0]).select("sample_id", "grp")


@register("usable_annotations", """
SELECT sample_id, a AS path FROM reg WHERE has_contact AND a <= 'CT3.bed.gz'""", ["reg"])
def usable_annotations(fx):
    return R.usable_annotations(_validated(fx))


@register("sample_filter", """
SELECT sample_id, cell_type FROM samples WHERE sample_id IN ('CT1_rep1', 'CT3') OR cell_type IN ('CT1_rep1', 'CT3')""",
          ["samples"])
def sample_filter(fx):
    wanted = fx.spark.createDataFrame([("CT1_rep1",), ("CT3",)], "name string")
    return R.wanted_samples(fx.samples.select("sample_id", "cell_type"), wanted, "cell_type").select("sample_id", "cell_type")


@register("locus_centroids", """
SELECT chr, start_bp, end_bp, CAST(p.p - 1 AS INTEGER) AS dim, round(avg(v[p.p]), 6) + 0.0E0 AS v,
  CAST(count(*) AS INTEGER) AS n_samples FROM members CROSS JOIN (SELECT unnest(range(1, 65)) AS p) p
GROUP BY 1,2,3, p.p""", ["members"])
def locus_centroids(fx):
    out = T.locus_centroids(fx.fingerprints)
    return (out.select("chr", "start_bp", "end_bp", "n_samples", F.posexplode("centroid").alias("dim", "v"))
            .select("chr", "start_bp", "end_bp", "dim", r6("v"), "n_samples"))


@register("n_tiles_refresh", """
SELECT s.sample_id, CAST(count(f.id) FILTER (f.chr <> 'chr1' AND f.sample_id <> 'CT0_rep1') AS INTEGER) AS n_tiles
FROM samples s LEFT JOIN fingerprints f USING (sample_id) GROUP BY 1""", ["samples", "fingerprints"])
def n_tiles_refresh(fx):
    some = fx.fingerprints.where("chr <> 'chr1' AND sample_id <> 'CT0_rep1'")
    return T.refresh_tile_counts(fx.samples.select("sample_id", F.lit(0).alias("n_tiles")), some).select("sample_id", "n_tiles")


@register("tile_counts", """
SELECT sample_id, count(*) AS n_tiles FROM fingerprints GROUP BY ROLLUP (sample_id)""", ["fingerprints"])
def tile_counts(fx):
    return T.tile_counts(fx.fingerprints)


# existing: chr1 and chr2; incoming: chr2 and chr3 with another value
@register("upsert_centroids", """
SELECT chr, start_bp, CASE WHEN chr = 'chr1' THEN 'old' ELSE 'new' END AS origin FROM loci""", ["loci"])
def upsert_centroids(fx):
    loci = fx.fingerprints.select("chr", "start_bp").distinct()
    old = loci.where("chr IN ('chr1', 'chr2', 'chr4')").withColumn("origin", F.lit("old"))
    new = loci.where("chr IN ('chr2', 'chr3', 'chr4', 'chr5')").withColumn("origin", F.lit("new"))
    return T.upsert(old, new, ["chr", "start_bp"])


@register("sample_insert", """
SELECT sample_id, CASE WHEN cell_type < 'CT4' THEN 'old' ELSE 'new' END AS origin FROM samples""", ["samples"])
def sample_insert(fx):
    s = fx.samples
    old = s.where("cell_type < 'CT4'").select("sample_id", F.lit("old").alias("origin"))
    new = s.where("cell_type > 'CT1'").select("sample_id", F.lit("new").alias("origin"))
    return T.insert_absent(old, new, "sample_id")


@register("overwrite_samples", """
SELECT id, sample_id FROM fingerprints WHERE sample_id NOT IN (SELECT sample_id FROM samples WHERE role = 'query')""",
          ["fingerprints", "samples"])
def overwrite_samples(fx):
    return T.without_samples(fx.fingerprints.select("id", "sample_id"), fx.samples.where("role = 'query'"))


@register("surrogate_ids", """
SELECT (SELECT max(id) FROM fingerprints WHERE chr = 'chr1')
    + row_number() OVER (ORDER BY sample_id, chr, start_bp) AS id, sample_id, chr, start_bp
FROM fingerprints WHERE chr <> 'chr1'""", ["fingerprints"])
def surrogate_ids(fx):
    f = fx.fingerprints
    new = f.where("chr <> 'chr1'").select("sample_id", "chr", "start_bp")
    return T.with_new_ids(f.where("chr = 'chr1'"), new, ["sample_id", "chr", "start_bp"]).select(
        "id", "sample_id", "chr", "start_bp")


@register("skip_done", """
SELECT DISTINCT sample_id, chr AS chrom FROM fingerprints WHERE NOT (chr IN ('chr1', 'chr2') AND sample_id < 'CT3')""",
          ["fingerprints"])
def skip_done(fx):
    asked = fx.fingerprints.select("sample_id", F.col("chr").alias("chrom")).distinct()
    return T.not_done(asked, asked.where("chrom IN ('chr1', 'chr2') AND sample_id < 'CT3'"))


@register("samples_present", """
SELECT DISTINCT sample_id FROM fingerprints WHERE sample_id IN ('CT0_rep1', 'CT9_rep9', 'CT2_rep2')""", ["fingerprints"])
def samples_present(fx):
    wanted = fx.spark.createDataFrame([("CT0_rep1",), ("CT9_rep9",), ("CT2_rep2",)], "sample_id string")
    return T.present_samples(fx.fingerprints, wanted)


@register("label_map", """
SELECT cell_type, CAST(row_number() OVER (ORDER BY cell_type) - 1 AS INTEGER) AS label
FROM (SELECT DISTINCT cell_type FROM samples)""", ["samples"])
def label_map(fx):
    return T.label_map(fx.samples, "cell_type")


@register("label_map_incremental", """
SELECT cell_type, CAST(row_number() OVER (ORDER BY sample_min > 'CT2_rep1', cell_type) - 1 AS INTEGER) AS label
FROM (SELECT cell_type, min(sample_id) AS sample_min FROM samples GROUP BY 1)""", ["samples"])
def label_map_incremental(fx):
    """Labels of a first run, continued over all samples in a second one."""
    first = T.label_map(fx.samples.where("sample_id <= 'CT2_rep1'"), "cell_type")
    return T.label_map_with(first, fx.samples, "cell_type").select("cell_type", F.col("label").cast("int").alias("label"))


_SPLIT = """
SELECT label, sum(CASE WHEN s = 'val' THEN n END) AS n_val, sum(CASE WHEN s = 'train' THEN n END) AS n_train FROM (
  SELECT label, 'val' AS s, greatest(1, CAST(floor(count(*)*0.1) AS BIGINT)) AS n FROM embeddings GROUP BY 1
  UNION ALL
  SELECT label, 'train', count(*) - greatest(1, CAST(floor(count(*)*0.1) AS BIGINT)) FROM embeddings GROUP BY 1)
GROUP BY 1"""


@register("stratified_split_counts", _SPLIT.replace("sum(", "CAST(sum(").replace(" END) AS", " END) AS BIGINT) AS"))
def stratified_split_counts(fx):
    return (T.stratified_split(fx.fingerprints.select("id", "label"), "label", "id").groupBy("label")
            .agg(F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(F.col("split") == "train").alias("n_train")))


@register("stratified_split", """
SELECT id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', id)), id)
    <= greatest(1, CAST(floor(count(*) OVER (PARTITION BY label)*0.1) AS BIGINT)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT vec_id AS id, label FROM embeddings)""")
def stratified_split(fx):
    return T.stratified_split(fx.fingerprints.select("id", "label"), "label", "id").select("id", "label", "split")


@register("global_split_counts", """
SELECT 'val' AS split, greatest(1, CAST(floor(count(*)*0.1) AS BIGINT)) AS n FROM embeddings
UNION ALL SELECT 'train', count(*) - greatest(1, CAST(floor(count(*)*0.1) AS BIGINT)) FROM embeddings""")
def global_split_counts(fx):
    return T.global_split(fx.fingerprints.select("id"), "id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# files: two per cell type and one annotation for some, by a shorter or longer name
define("fls", """
SELECT DISTINCT concat('/x/', sample_id, '_4DNFI2A4OBS9.mcool') AS path, 1000*length(sample_id) AS length, cell_type FROM samples""",
       ["samples"])


def _files(fx):
    return fx.samples.select(F.concat(F.lit("/x/"), "sample_id", F.lit("_4DNFI2A4OBS9.mcool")).alias("path"),
                             (F.length("sample_id") * 1000).cast("long").alias("length"))


@register("file_catalogue", """
SELECT cell_type AS cell, count(*) AS n_files, round(sum(length)/1e9, 9) AS total_gb,
  cell_type IN ('CT0', 'CT1', 'CT2') AS has_annotation FROM fls GROUP BY 1""", ["fls"])
def file_catalogue(fx):
    ann = fx.spark.createDataFrame([("CT0", "/a/1"), ("ct1_long", "/a/2"), ("CT2", "/a/3")], "key string, path string")
    return collection.catalogue(_files(fx), ann).select("cell", "n_files", F.round("total_gb", 9).alias("total_gb"), "has_annotation")


@register("first_files", "SELECT cell_type AS cell, min(path) AS path FROM fls GROUP BY 1", ["fls"])
def first_files(fx):
    return collection.first_files(_files(fx)).select("cell", "path")


@register("annotation_file_match", """
SELECT cell_type AS cell, CASE cell_type WHEN 'CT0' THEN '/a/1' WHEN 'CT1' THEN '/a/2' WHEN 'CT2' THEN '/a/3' END AS annotation_path
FROM (SELECT DISTINCT cell_type FROM samples)""", ["samples"])
def annotation_file_match(fx):
    ann = fx.spark.createDataFrame([("CT0", "/a/1"), ("ct1_long", "/a/2"), ("CT2", "/a/3"), ("CT2x", "/a/0")],
                                   "key string, path string")
    return A.match_annotation_files(fx.samples.select(F.col("cell_type").alias("cell")), ann)


@register("score_labels", """
SELECT id, CASE WHEN s > 0.7 THEN 'STRUCTURALLY_SIMILAR' WHEN s > 0.3 THEN 'PARTIALLY_SIMILAR' ELSE 'STRUCTURALLY_DIFFERENT' END AS strict,
  CASE WHEN s < 0.3 THEN 'STRUCTURALLY_DIFFERENT' WHEN s < 0.7 THEN 'PARTIALLY_SIMILAR' ELSE 'STRUCTURALLY_SIMILAR' END AS inclusive,
  CASE WHEN s < 0.3 THEN 'DIVERGENT' WHEN s < 0.7 THEN 'PARTIAL' ELSE 'SIMILAR' END AS short,
  CASE WHEN s > 0.95 THEN 'STRUCTURALLY IDENTICAL' WHEN s > 0.88 THEN 'VERY SIMILAR' WHEN s > 0.75 THEN 'SIMILAR' ELSE 'DIFFERENT' END AS verdict,
  CASE WHEN s >= 0.8 THEN 'EXCELLENT — publication ready' WHEN s >= 0.65 THEN 'GOOD — suitable for retrieval'
       WHEN s >= 0.45 THEN 'FAIR — usable but needs improvement' ELSE 'POOR — needs more training' END AS quality
FROM (SELECT vec_id AS id, (vec_id % 101)/100.0E0 AS s FROM embeddings)""")
def score_labels(fx):
    s = (F.col("id") % 101) / F.lit(100.0)
    return fx.fingerprints.select(
        "id", L.similarity_class(s).alias("strict"), L.similarity_class_inclusive(s).alias("inclusive"),
        L.window_status(s).alias("short"), L.pair_verdict(s).alias("verdict"), L.retrieval_verdict(s).alias("quality"))


@register("centroid_index", """
SELECT chr, start_bp, CAST(p - 1 AS INTEGER) AS dim, round(CAST(CAST(x/sqrt(sum(x*x) OVER (PARTITION BY chr, start_bp)) AS FLOAT) AS DOUBLE), 6) + 0.0E0 AS v
FROM (SELECT chr, start_bp, p.p, avg(v[p.p]) AS x FROM members CROSS JOIN (SELECT unnest(range(1, 65)) AS p) p
  GROUP BY 1,2,3)""", ["members"])
def centroid_index(fx):
    out = T.centroid_index(T.locus_centroids(fx.fingerprints)).select("chr", "start_bp", F.posexplode("vector").alias("dim", "v"))
    return out.select("chr", "start_bp", "dim", (F.round(F.col("v").cast("double"), 6) + F.lit(0.0)).alias("v"))


@register("loci_per_chromosome", """
SELECT chr, count(*) AS n_loci, CAST(sum(n) AS BIGINT) AS n_fingerprints
FROM (SELECT chr, start_bp, count(*) AS n FROM fingerprints GROUP BY 1,2) GROUP BY 1""", ["fingerprints"])
def loci_per_chromosome(fx):
    """Ad-hoc SQL over a stored table."""
    return fx.spark.sql(
        "SELECT chr, count(*) AS n_loci, sum(n_samples) AS n_fingerprints FROM {c} GROUP BY chr",
        c=T.locus_centroids(fx.fingerprints))
