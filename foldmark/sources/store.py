"""The fingerprint store on shared storage: parquet tables, idempotent appends, sinks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as T
from ..operators import tables

TABLES = {
    "samples": T.SAMPLES, "window_fingerprints": T.FINGERPRINTS,
    "sample_histograms": T.HISTOGRAMS, "locus_centroids": T.CENTROIDS, "centroid_index": T.CENTROID_INDEX,
}
PARTITIONS = {"window_fingerprints": ["chr"]}


class Store:
    """Named parquet tables under one root.

    A table is a folder of versions; the current one is the highest that carries the
    ``_SUCCESS`` file Spark writes last, so a version that was cut short is never read and the
    one before it stays in force. Fingerprints are partitioned by chromosome and sorted by start inside
    the files, so a locus lookup reads one partition and few row groups.

    An append adds files to the current version. Spark moves them in at the end of the job, so one that is cut short during
    that commit may leave some of its files to readers; running it again completes it, as stored keys are left out.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def versions(self, name: str) -> list[int]:
        """Numbers of the complete versions of a table."""
        fs, p = self._fs(self.path(name))
        found = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(x[1:]) for x in found if x[0] == "v" and x[1:].isdigit()
                      and self._exists(f"{self.path(name)}/{x}/_SUCCESS"))

    def _folder(self, name, number) -> str:
        return f"{self.path(name)}/v{number}"

    def read(self, name: str) -> DataFrame:
        """The current version, empty with its schema when the table was never written."""
        done = self.versions(name)
        if not done:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(self._folder(name, done[-1]))

    def _writer(self, df, name, mode):
        parts = PARTITIONS.get(name, [])
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]])
        if parts:
            df = df.repartitionByRange(*parts, "start_bp").sortWithinPartitions(*parts, "start_bp")
        w = df.write.mode(mode)
        return w.partitionBy(*parts) if parts else w

    def append(self, name: str, df: DataFrame):
        done = self.versions(name)
        if done:
            self._writer(df, name, "append").parquet(self._folder(name, done[-1]))
        else:
            self.replace(name, df)

    def replace(self, name: str, df: DataFrame):
        """Write the next version; it counts once it is complete, and only then the older ones go.

        The new rows may be computed from the version before.
        """
        done = self.versions(name)
        number = (done[-1] if done else 0) + 1
        self._writer(df, name, "overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(
            self._folder(name, number))
        if self.versions(name)[-1] != number:
            raise OSError(f"version {number} of {name} is not complete")
        for old in done:
            fs, p = self._fs(self._folder(name, old))
            fs.delete(p, True)

    def register_samples(self, registry: DataFrame):
        """Insert registry rows that are not there yet; the cell type is the sample id."""
        rows = registry.select(
            "sample_id", F.col("sample_id").alias("cell_type"), F.coalesce("tissue", F.lit("unknown")).alias("tissue"),
            F.col("assay").alias("assay_type"), F.lit("4DN").alias("source"), F.lit(0).alias("n_tiles"))
        self.append("samples", tables.new_rows(self.read("samples"), rows, "sample_id"))

    def ingest(self, fingerprints: DataFrame):
        """Append fingerprints, skipping (sample, chr, start) keys already stored; ids run on."""
        old = self.read("window_fingerprints")
        key = ["sample_id", "chr", "start_bp"]
        # only the stored rows of the batch's samples and chromosomes can meet it
        near = old.join(fingerprints.select("sample_id", "chr").distinct(), ["sample_id", "chr"], "left_semi")
        fresh = tables.new_rows(near, fingerprints, key)
        for c in ("boundary", "compartment", "ccre_annot"):
            if c not in fresh.columns:
                fresh = fresh.withColumn(c, F.lit(None).cast("array<float>"))
        self.append("window_fingerprints", tables.with_new_ids(old, fresh, key))

    def overwrite_samples(self, samples: DataFrame):
        """Drop fingerprints and histograms of the given samples, and all centroids."""
        for name in ("window_fingerprints", "sample_histograms"):
            self.replace(name, tables.without_samples(self.read(name), samples))
        self.replace("locus_centroids", self.spark.createDataFrame([], TABLES["locus_centroids"]))

    def refresh(self):
        """Recount tiles and recompute the centroids from the stored fingerprints."""
        f = self.read("window_fingerprints")
        self.replace("samples", tables.refresh_tile_counts(self.read("samples"), f))
        centroids = tables.upsert(self.read("locus_centroids"),
                                  tables.locus_centroids(f).withColumn("centroid", F.col("centroid").cast("array<float>")),
                                  ["chr", "start_bp"])
        self.replace("locus_centroids", centroids)
        self.replace("centroid_index", tables.centroid_index(self.read("locus_centroids")))

    def upsert_histograms(self, hist: DataFrame):
        self.replace("sample_histograms", tables.upsert(self.read("sample_histograms"), hist, "sample_id"))

    def views(self):
        """Temp views over all tables, for ad-hoc SQL."""
        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)


def write_tiles(tiles: DataFrame, path: str, mode: str = "append"):
    """Tiles by sample and chromosome; a reader of one sample prunes to its folder."""
    tiles.repartition("sample_id", "chr").write.mode(mode).partitionBy("sample_id", "chr").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.TILES).parquet(path)


def write_label_map(labels: DataFrame, path: str):
    labels.coalesce(1).write.mode("overwrite").json(path)


def read_label_map(spark: SparkSession, path: str, tiles: DataFrame | None = None) -> DataFrame:
    """The stored label map, or sorted sample names numbered from 0 when there is none."""
    store = Store(spark, path)
    if store._exists(path):
        return spark.read.schema("cell_line_name string, label int").json(path)
    return tables.label_map(tiles, "sample_id").withColumnRenamed("sample_id", "cell_line_name")


def write_timing(log: DataFrame, path: str):
    """Tab-separated timing log with one decimal."""
    one = lambda c: F.format_string("%.1f", F.col(c).cast("double")).alias(c)
    (log.select("sample_id", "status", one("file_mb"), "tiles", one("elapsed_s")).coalesce(1)
     .write.mode("overwrite").option("sep", "\t").option("header", True).csv(path))


def write_report(report: DataFrame, path: str):
    """Nested report rows as JSON lines."""
    report.write.mode("overwrite").json(path)
