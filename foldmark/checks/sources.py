"""Readers, store and streams on files that Spark writes from the test tables, and the SQL functions."""

import uuid

from pyspark.sql import functions as F

from .. import constants as C
from .. import schema as T
from ..functions import names as N
from ..functions import sql
from ..operators import annotation as A
from ..operators import codes as K
from ..plans import build, quality
from ..sources import files, store
from ..sources.scratch import shared_folder
from ..streaming import ingest
from .annotation import _ccre
from .base import define, r6, registry

QUERIES, ORACLES, register = registry()


def _place(fx, name):
    return f"{shared_folder(fx.spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df, *parts):
    return df.select(F.concat_ws("\t", *[F.col(p).cast("string") if p in df.columns else F.lit(p) for p in parts]).alias("value"))


# every tenth element line is cut short and some are comments: both are left out
@register("parse_ccre", """
SELECT sample_id, chrom, start_bp, end_bp, category FROM (
  SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM (
    SELECT event_id, concat('CT', user_id % 7) AS sample_id, concat('chr', 1 + user_id % 5) AS chrom, (event_id * 7919) % 76800000 AS start_bp,
      (event_id * 7919) % 76800000 + 150 + event_id % 200 AS end_bp,
      CASE (event_id * 31) % 11 WHEN 0 THEN 'PLS' WHEN 1 THEN 'pELS' WHEN 2 THEN 'dELS' WHEN 3 THEN 'CA-CTCF' WHEN 4 THEN 'CA-TF'
        WHEN 5 THEN 'CA-H3K4me3' WHEN 6 THEN 'CA-only' WHEN 7 THEN 'High-H3K27ac' WHEN 8 THEN 'High-H3K4me3' ELSE 'Low-DNase' END AS category
    FROM events)) WHERE start_bp % 10 <> 0""")
def parse_ccre(fx):
    c = fx.ccre.withColumn("padded", F.concat("category", F.lit(" ")))
    whole = _lines(c.where("start_bp % 10 <> 0"), "chrom", "start_bp", "end_bp", "sample_id", *"....", "_", "padded")
    short = _lines(c.where("start_bp % 10 = 0"), "chrom", "start_bp", "end_bp")
    path = _place(fx, "bed")
    note = fx.spark.range(3).select(F.lit("# a comment").alias("value"))
    whole.unionByName(short).unionByName(note).write.option("compression", "gzip").text(path)
    out = files.read_ccre(fx.spark, path, with_name=True)
    return out.select(F.col("name").alias("sample_id"), "chrom", "start_bp", "end_bp", "category")


@register("parse_genes", """
SELECT concat('chr', 1 + p_partkey % 5) AS chrom, (p_partkey * 38393) % 76800000 AS start_bp,
  (p_partkey * 38393) % 76800000 + 1000 + p_size * 2000 AS end_bp, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  concat('G', p_partkey) AS gene_id, CASE WHEN p_partkey % 7 = 0 THEN concat('G', p_partkey) ELSE concat('N', p_partkey) END AS gene_name,
  CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE 'lncRNA' END AS gene_type FROM part""")
def parse_genes(fx):
    """GTF lines of genes, some without name or type, among exon lines and comments."""
    k = F.col("gene_id").substr(F.lit(2), F.lit(20)).cast("long")
    attrs = F.concat(F.lit('gene_id "'), "gene_id", F.lit('";'),
                     F.when(k % 3 != 0, ' gene_type "lncRNA";').otherwise(""),
                     F.when(k % 7 != 0, F.concat(F.lit(' gene_name "N'), k.cast("string"), F.lit('";'))).otherwise(""))
    g = fx.genes.select("chrom", (F.col("start_bp") + 1).alias("first"), "end_bp", F.when(k % 2 == 0, "+").otherwise("-").alias("strand"),
                        attrs.alias("attrs"), F.explode(F.array(F.lit("gene"), F.lit("exon"))).alias("feature"))
    path = _place(fx, "gtf")
    note = fx.spark.range(2).select(F.lit("##description").alias("value"))
    _lines(g, "chrom", "HAVANA", "feature", "first", "end_bp", ".", "strand", ".", "attrs").unionByName(note).write.text(path)
    return files.read_genes(fx.spark, path).select("chrom", "start_bp", "end_bp", "strand", "gene_id", "gene_name", "gene_type")


@register("parse_cytoband", "SELECT * FROM cytoband", ["cytoband"])
def parse_cytoband(fx):
    path = _place(fx, "bands")
    _lines(fx.cytoband, "chrom", "start_bp", "end_bp", "name", "giestain").write.text(path)
    return files.read_cytoband(fx.spark, path)


@register("parse_pixels", """
SELECT sample_id, chrom, count(*) AS n, round(sum(cnt), 6) AS total, sum(bin2 - bin1)::BIGINT AS reach FROM pixels GROUP BY 1, 2""", ["pixels"])
def parse_pixels(fx):
    path = _place(fx, "pixels")
    fx.pixels.select("sample_id", "chrom", F.col("bin1").cast("long").alias("bin1"), F.col("bin2").cast("long").alias("bin2"),
                     F.col("cnt").cast("double").alias("cnt")).write.parquet(path)
    p = files.read_pixels(fx.spark, path)
    return p.groupBy("sample_id", "chrom").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cnt"), 6).alias("total"),
                                               F.sum(F.col("bin2") - F.col("bin1")).alias("reach"))


@register("parse_bins", """
SELECT chrom, count(*) AS n, count(weight) AS weighted, round(sum(weight), 6) AS total FROM bins GROUP BY 1""", ["bins"])
def parse_bins(fx):
    path = _place(fx, "bins")
    fx.bins.write.parquet(path)
    return files.read_bins(fx.spark, path).groupBy("chrom").agg(
        F.count(F.lit(1)).alias("n"), F.count("weight").alias("weighted"), F.round(F.sum("weight"), 6).alias("total"))


_FIXED = ", ".join(f"('{a}', '/r/{b}')" for a, b in C.FALLBACK_ANNOTATIONS)


# cells with a file of their own name; with no file at all the fixed entries
@register("annotation_registry", f"""
SELECT 'found' AS kind, sample_id, concat('/x/', sample_id, '.bed.gz') AS path FROM samples WHERE sample_id LIKE '%rep1'
UNION ALL SELECT 'fixed', * FROM (VALUES {_FIXED}) v(sample_id, path)""", ["samples"])
def annotation_registry(fx):
    some = fx.samples.where("sample_id LIKE '%rep1'").select(F.concat(F.lit("/x/"), "sample_id", F.lit(".bed.gz")).alias("path"))
    found = A.annotation_registry(fx.samples.where("sample_id LIKE '%rep1'"), some, "/r")
    fixed = A.annotation_registry(fx.samples, some.where("false"), "/r")
    return found.select(F.lit("found").alias("kind"), "sample_id", "path").unionByName(
        fixed.select(F.lit("fixed").alias("kind"), "sample_id", "path"))


@register("sample_registry", """
SELECT sample_id, concat(sample_id, '_4DNFI2A4OBS9.mcool') AS file, 'bulk_hic' AS assay, 'unknown' AS tissue FROM samples""", ["samples"])
def sample_registry(fx):
    paths = fx.samples.select(F.concat(F.lit("/x/"), "sample_id", F.lit("_4DNFI2A4OBS9.mcool")).alias("path"))
    return files.registry_or_fallback(paths)


@register("group_files", """
SELECT cell_type AS cell, count(*) AS n, min(concat('/x/', sample_id, '.mcool')) AS first FROM samples GROUP BY 1""", ["samples"])
def group_files(fx):
    paths = fx.samples.select(F.concat(F.lit("/x/"), "sample_id", F.lit(".mcool")).alias("path"))
    return files.group_files(paths).select("cell", F.size("paths").cast("long").alias("n"), F.col("paths")[0].alias("first"))


@register("assay_codes", """
SELECT sample_id, CAST(CASE sample_id WHEN 'S2' THEN 1 WHEN 'S3' THEN 2 WHEN 'S4' THEN 3 ELSE 0 END AS INTEGER) AS code
FROM (SELECT DISTINCT sample_id FROM pixels)""", ["pixels"])
def assay_codes(fx):
    name = F.get(F.array(*[F.lit(x) for x in ("bulk_hic", "micro_c", "sc_hic", "chia_pet", "other")]), F.substring("sample_id", 2, 2).cast("int") - 1)
    return fx.pixels.select("sample_id").distinct().select("sample_id", N.assay_code(name).alias("code"))


_CURATED = ", ".join(f"'{g}'" for g in sorted(set(C.ONCOGENES) | set(C.TUMOR_SUPPRESSORS) | set(C.CHROMATIN_REGULATORS)))


@register("curated_genes", f"SELECT gene_name, count(*) AS n FROM genes WHERE gene_name IN ({_CURATED}) GROUP BY 1", ["genes"])
def curated_genes(fx):
    return fx.genes.join(files.curated_genes(fx.spark), "gene_name", "left_semi").groupBy("gene_name").agg(F.count(F.lit(1)).alias("n"))


@register("stored_label_map", """
SELECT sample_id AS cell_line_name, CAST(row_number() OVER (ORDER BY sample_id) - 1 AS INTEGER) AS label FROM samples""", ["samples"])
def stored_label_map(fx):
    path = _place(fx, "labels")
    made = store.read_label_map(fx.spark, path, fx.samples)  # none is stored yet
    store.write_label_map(made, path)
    return store.read_label_map(fx.spark, path)


@register("timing_log", """
SELECT sample_id, 'ok' AS status, printf('%.1f', count(*)*1.3E0) AS file_mb, count(*) AS tiles FROM fingerprints GROUP BY 1""", ["fingerprints"])
def timing_log(fx):
    path = _place(fx, "timing")
    n = fx.fingerprints.groupBy("sample_id").agg(F.count(F.lit(1)).alias("tiles"))
    store.write_timing(n.select("sample_id", F.lit("ok").alias("status"), (F.col("tiles") * 1.3).alias("file_mb"), "tiles",
                                F.lit(0.5).alias("elapsed_s")), path)
    return fx.spark.read.option("sep", "\t").option("header", True).schema(
        "sample_id string, status string, file_mb string, tiles long, elapsed_s string").csv(path).drop("elapsed_s")


def _store(fx):
    st = store.Store(fx.spark, _place(fx, "store"))
    st.register_samples(fx.samples.select("sample_id", F.lit("bulk_hic").alias("assay"), "tissue"))
    return st


@register("store_histograms", """
SELECT s.sample_id, CAST(c.code AS INTEGER) AS code,
  round(CAST(CAST(count(a.code)/(sum(count(a.code)) OVER (PARTITION BY s.sample_id) + 1e-8) AS FLOAT) AS DOUBLE), 5) AS p
FROM (SELECT DISTINCT sample_id FROM asg) s CROSS JOIN (SELECT unnest(range(0, 16)) AS code) c
LEFT JOIN asg a ON a.sample_id = s.sample_id AND a.code = c.code GROUP BY 1,2""", ["asg"])
def store_histograms(fx):
    """The histogram table of a store build."""
    who = fx.fingerprints.select(F.col("id").alias("vec_id"), "sample_id")
    tokens = fx.tokens.join(who, "vec_id").select("sample_id", "token")
    tiles = fx.fingerprints.select("sample_id", "chr", "start_bp", "end_bp", F.col("fingerprint").alias("matrix"))
    none = fx.spark.createDataFrame([], T.FINGERPRINTS)
    made = build.build_store(tiles, build.mean_projection(64), _store(fx).read("samples"), none, tokens=tokens, codebook=fx.codebook)
    return made["sample_histograms"].select("sample_id", F.posexplode("code_histogram").alias("code", "p")).select(
        "sample_id", "code", F.round(F.col("p").cast("double"), 5).alias("p"))


@register("ingest_two_batches", """
SELECT sample_id, chr, start_bp, CAST(d - 1 AS INTEGER) AS dim, round(CAST(CAST(list_avg(CAST(fingerprint[d*8 - 7:d*8] AS DOUBLE[])) AS FLOAT) AS DOUBLE), 5)
  + 0.0E0 AS v, (SELECT count(*) FROM fingerprints) AS n_ids FROM fingerprints, (SELECT unnest(range(1, 9)) AS d)""", ["fingerprints"])
def ingest_two_batches(fx):
    """Tiles that arrive in two batches, one of them twice, are stored once with running ids."""
    st, src, at = _store(fx), _place(fx, "tiles"), _place(fx, "checkpoint")
    tiles = fx.fingerprints.select(
        "id", "sample_id", F.lit("x").alias("cell_line_name"), F.lit(0).alias("cell_line_idx"), "chr", F.col("start_bp").alias("start_bin"),
        F.col("end_bp").alias("end_bin"), "start_bp", "end_bp", F.col("fingerprint").alias("matrix"))
    for part in ("id % 2 = 0", "id % 4 <> 2"):
        tiles.where(part).drop("id").write.mode("append").parquet(src)
        ingest.ingest_stream(ingest.tile_stream(fx.spark, src), st, build.mean_projection(8), at, dim=8).awaitTermination()
    f = st.read("window_fingerprints")
    n = f.agg(F.count_distinct("id").alias("n")).scalar()
    return f.select("sample_id", "chr", "start_bp", n.alias("n_ids"), F.posexplode("fingerprint").alias("dim", "v")).select(
        "sample_id", "chr", "start_bp", "dim", (F.round(F.col("v").cast("double"), 5) + F.lit(0.0)).alias("v"), "n_ids")


# two batches by tile: the codebook of the second starts from that of the first
_BATCH = """
a{k} AS (SELECT token, best.c AS code FROM (SELECT t.token, min(struct_pack(d := round(pow(list_distance(t.token, c.v), 2), 12), c := c.code)) AS best
  FROM tk t, s{j} c WHERE t.vec_id % 2 = {odd} GROUP BY t.vec_id, t.pos, t.token)),
m{k} AS (SELECT c.code, p, any_value(0.995E0*c.n) + (1 - 0.995E0)*count(a.token) AS n,
    any_value(0.995E0*c.s[p]) + (1 - 0.995E0)*coalesce(sum(a.token[p]), 0) AS x
  FROM s{j} c CROSS JOIN (SELECT unnest(range(1, 9)) AS p) LEFT JOIN a{k} a ON a.code = c.code GROUP BY 1, 2),
s{k} AS (SELECT code, any_value(n) AS n, list(x ORDER BY p) AS s, list(x/((n + 1e-5)/(t + 16*1e-5)*t) ORDER BY p) AS v
  FROM m{k}, (SELECT sum(n) AS t FROM m{k} WHERE p = 1) GROUP BY code)"""


@register("codebook_two_batches", "WITH {steps}, s0 AS (SELECT code, 1.0E0 AS n, vec AS s, vec AS v FROM cb)," + _BATCH.format(k=1, j=0, odd=0)
          + "," + _BATCH.format(k=2, j=1, odd=1) + """
SELECT code, CAST(p - 1 AS INTEGER) AS dim, round(v[p], 6) + 0.0E0 AS v FROM s2, (SELECT unnest(range(1, 9)) AS p)""", ["cb", "tk"])
def codebook_two_batches(fx):
    state, src, at = ingest.CodeState(fx.spark, _place(fx, "codes")), _place(fx, "tokens"), _place(fx, "checkpoint")
    state.start(fx.codebook)
    for odd in (0, 1):
        fx.tokens.where(F.col("vec_id") % 2 == odd).coalesce(1).write.mode("append").parquet(src)
        stream = fx.spark.readStream.schema("vec_id long, pos int, token array<float>").parquet(src)
        ingest.code_stream(stream, state, ["vec_id", "pos"], 8, at).awaitTermination()
    return state.version(2).select("code", F.posexplode("vec").alias("dim", "v")).select("code", "dim", r6("v"))


@register("adhoc_sql", """
SELECT q.sample_id, r.sample_id AS match, q.chr, q.start_bp, round(list_dot_product(q.v, r.v)/(q.len*r.len), 6) + 0.0E0 AS score,
  CASE WHEN list_dot_product(q.v, r.v)/(q.len*r.len) > 0.7 THEN 'STRUCTURALLY_SIMILAR' WHEN list_dot_product(q.v, r.v)/(q.len*r.len) > 0.3
    THEN 'PARTIALLY_SIMILAR' ELSE 'STRUCTURALLY_DIFFERENT' END AS status
FROM members q JOIN members r ON q.chr = r.chr AND q.start_bp = r.start_bp WHERE q.sample_id = 'CT0_rep1' AND r.sample_id <> 'CT0_rep1'""",
          ["members"])
def adhoc_sql(fx):
    """A user's own SQL over the store's views with the registered functions."""
    sql.register(fx.spark)
    st = _store(fx)
    st.ingest(fx.fingerprints.select("sample_id", "chr", "start_bp", "end_bp", "fingerprint"))
    st.views()
    return fx.spark.sql("""
        SELECT q.sample_id, r.sample_id AS match, q.chr, q.start_bp,
          round(vector_cosine(q.fingerprint, r.fingerprint), 6) + 0.0D AS score,
          similarity_status(vector_cosine(q.fingerprint, r.fingerprint)) AS status
        FROM window_fingerprints q JOIN window_fingerprints r ON q.chr = r.chr AND q.start_bp = r.start_bp
        WHERE q.sample_id = 'CT0_rep1' AND r.sample_id <> 'CT0_rep1'""")


@register("sql_concordance", """
SELECT a.vec_id, CAST(a.pos AS INTEGER) AS pos, round((SELECT sum((x - mx)*(y - my))/(sqrt(sum(pow(x - mx, 2))*sum(pow(y - my, 2))) + 1e-8)
  FROM (SELECT unnest(a.token) AS x, unnest(b.token) AS y, list_avg(a.token) AS mx, list_avg(b.token) AS my)), 6) + 0.0E0 AS r
FROM tk a JOIN tk b ON b.vec_id = a.vec_id AND b.pos = a.pos + 1""", ["tk"])
def sql_concordance(fx):
    sql.register(fx.spark)
    t = fx.tokens.select("vec_id", "pos", F.col("token").cast("array<double>").alias("token"))
    return fx.spark.sql("""
        SELECT a.vec_id, a.pos, round(profile_concordance(a.token, b.token), 6) + 0.0D AS r
        FROM {t} a JOIN {t} b ON b.vec_id = a.vec_id AND b.pos = a.pos + 1""", t=t)


@register("ccre_coords_udtf", "SELECT * FROM hits", ["hits"])
def ccre_coords_udtf(fx):
    sql.register(fx.spark)
    fx.windows.createOrReplaceTempView("windows")
    _ccre(fx).createOrReplaceTempView("elements")
    return fx.spark.sql(sql.ELEMENTS_OF_WINDOWS)


@register("quality_evaluate", """
SELECT count(DISTINCT label) AS n_cell_types, count(*) AS n_windows FROM embeddings""")
def quality_evaluate(fx):
    """Train and validation parts are judged together."""
    rows = fx.fingerprints.select("id", "label", "fingerprint")
    return quality.evaluate(rows.where("id % 10 <> 0"), rows.where("id % 10 = 0")).select("n_cell_types", "n_windows")
