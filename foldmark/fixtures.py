"""Views that map the generic test tables onto the library's inputs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# text valid in both engines; {0} style placeholders are not used
SQL = {
    "fingerprints": """
SELECT vec_id AS id,
  concat('CT', CAST(CAST(floor(vec_id/25) AS BIGINT) % 7 AS STRING), '_rep',
         CAST(1 + CAST(floor(floor(vec_id/25)/7) AS BIGINT) AS STRING)) AS sample_id,
  concat('chr', CAST(1 + (vec_id % 25) % 5 AS STRING)) AS chr,
  CAST(floor((vec_id % 25)/5) AS BIGINT) * 12800000 AS start_bp,
  CAST(floor((vec_id % 25)/5) AS BIGINT) * 12800000 + 25600000 AS end_bp,
  embedding AS fingerprint, label
FROM embeddings""",
    "samples": """
SELECT DISTINCT
  concat('CT', CAST(CAST(floor(vec_id/25) AS BIGINT) % 7 AS STRING), '_rep',
         CAST(1 + CAST(floor(floor(vec_id/25)/7) AS BIGINT) AS STRING)) AS sample_id,
  concat('CT', CAST(CAST(floor(vec_id/25) AS BIGINT) % 7 AS STRING)) AS cell_type,
  CASE CAST(floor(vec_id/25) AS BIGINT) % 3 WHEN 0 THEN 'leukemia'
       WHEN 1 THEN 'lung_fibroblast' ELSE 'unknown' END AS tissue,
  'bulk_hic' AS assay_type,
  CASE WHEN CAST(floor(vec_id/25) AS BIGINT) % 10 = 0 THEN 'query' ELSE 'ref' END AS role
FROM embeddings""",
    "ccre": """
SELECT concat('CT', CAST(user_id % 7 AS STRING)) AS sample_id,
  concat('chr', CAST(1 + user_id % 5 AS STRING)) AS chrom,
  (event_id * 7919) % 76800000 AS start_bp,
  (event_id * 7919) % 76800000 + 150 + event_id % 200 AS end_bp,
  CASE (event_id * 31) % 11 WHEN 0 THEN 'PLS' WHEN 1 THEN 'pELS' WHEN 2 THEN 'dELS'
    WHEN 3 THEN 'CA-CTCF' WHEN 4 THEN 'CA-TF' WHEN 5 THEN 'CA-H3K4me3' WHEN 6 THEN 'CA-only'
    WHEN 7 THEN 'High-H3K27ac' WHEN 8 THEN 'High-H3K4me3' WHEN 9 THEN 'Low-DNase'
    ELSE 'Unclassified' END AS category
FROM events""",
    "genes": """
SELECT concat('G', CAST(p_partkey AS STRING)) AS gene_id,
  concat('chr', CAST(1 + p_partkey % 5 AS STRING)) AS chrom,
  (p_partkey * 38393) % 76800000 AS start_bp,
  (p_partkey * 38393) % 76800000 + 1000 + p_size * 2000 AS end_bp,
  CASE WHEN p_partkey % 40 = 0 THEN 'MYC' WHEN p_partkey % 40 = 1 THEN 'TP53'
       WHEN p_partkey % 40 = 2 THEN 'CTCF' WHEN p_partkey % 40 = 3 THEN 'EED'
       WHEN p_partkey % 40 = 4 THEN 'EZH2' ELSE concat('GENE', CAST(p_partkey AS STRING)) END AS gene_name,
  'protein_coding' AS gene_type
FROM part""",
    "pixels": """
SELECT concat('S', CAST(l_linenumber AS STRING)) AS sample_id,
  concat('chr', CAST(1 + l_suppkey % 2 AS STRING)) AS chrom,
  least(l_partkey % 96, l_orderkey % 96) AS bin1,
  greatest(l_partkey % 96, l_orderkey % 96) AS bin2,
  sum(l_quantity) AS cnt
FROM lineitem GROUP BY 1,2,3,4""",
    "cytoband": """
SELECT concat('chr', CAST(1 + n_nationkey % 5 AS STRING)) AS chrom,
  CAST(floor(n_nationkey/5) AS BIGINT) * 2000000 AS start_bp,
  CAST(floor(n_nationkey/5) AS BIGINT) * 2000000 + 1950000 AS end_bp,
  concat('p', CAST(n_nationkey AS STRING)) AS name,
  CASE n_nationkey % 6 WHEN 0 THEN 'gneg' WHEN 1 THEN 'acen' WHEN 2 THEN 'gpos50'
       WHEN 3 THEN 'gvar' WHEN 4 THEN 'stalk' ELSE 'gneg' END AS giestain
FROM nation""",
}

N_BINS = 96
TILE, STEP = 32, 16


# explicit schemas of the columns used: no schema-inference job per read
TABLES = {
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, user_id bigint",
    "part": "p_partkey bigint, p_size int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double",
    "nation": "n_nationkey int",
}


class Fixture:
    """The views over one directory of test tables."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self._made = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.schema(TABLES[name]).parquet(f"{self.directory}/{name}.parquet")
        return self._made[name]

    def _view(self, view: str, table: str) -> DataFrame:
        if view not in self._made:
            text = SQL[view].replace(f"FROM {table}", "FROM {t}")
            self._made[view] = self.spark.sql(text, t=self.table(table))
        return self._made[view]

    @property
    def fingerprints(self):
        return self._view("fingerprints", "embeddings")

    @property
    def samples(self):
        return self._view("samples", "embeddings")

    @property
    def ccre(self):
        return self._view("ccre", "events")

    @property
    def genes(self):
        return self._view("genes", "part")

    @property
    def pixels(self):
        return self._view("pixels", "lineitem")

    @property
    def cytoband(self):
        return self._view("cytoband", "nation")

    @property
    def tokens(self):
        """Eight tokens of eight values per vector."""
        return (self.table("embeddings")
                .select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"))
                .select("vec_id", "pos", F.slice("embedding", F.col("pos") * 8 + 1, 8).alias("token")))

    @property
    def codebook(self):
        return (self.table("embeddings").where("vec_id < 16")
                .select(F.col("vec_id").cast("int").alias("code"), F.slice("embedding", 1, 8).alias("vec")))

    @property
    def bins(self):
        """Bin weights of every (sample, chromosome) that has pixels."""
        return (self.pixels.select("sample_id", "chrom").distinct()
                .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_BINS - 1).cast("long"))).alias("bin"))
                .withColumn("weight", F.when(F.col("bin") % 17 != 0, F.lit(1.0) / (3 + F.col("bin") % 10))))

    def members(self, role: str):
        """Fingerprints of query or reference samples, with cell type and tissue."""
        if role not in self._made:
            who = self.samples.where(F.col("role") == role).select("sample_id", "cell_type", "tissue")
            self._made[role] = self.fingerprints.drop("label").join(who, "sample_id")
        return self._made[role]

    @property
    def windows(self):
        """Annotation windows of every cell type."""
        who = self.samples.select("sample_id", "cell_type")
        return (self.fingerprints.join(who, "sample_id")
                .select(F.col("cell_type").alias("sample_id"), F.col("chr").alias("chrom"),
                        F.col("start_bp").alias("win_start"), F.col("end_bp").alias("win_end")).distinct())

    @property
    def loci(self):
        return self.fingerprints.select(F.col("chr").alias("chrom"), F.col("start_bp").alias("win_start"),
                                        F.col("end_bp").alias("win_end")).distinct()
