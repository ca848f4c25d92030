"""Incremental work: new tiles into the store, running code statistics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schema as T
from ..operators import codes, tables
from ..sources.store import Store


def tile_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Tiles as they are written to a directory."""
    return spark.readStream.schema(T.TILES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_stream(tiles: DataFrame, store: Store, encode, checkpoint: str, dim: int = C.FP_DIM):
    """Encode every new tile and append its fingerprint once.

    A batch that is run again after a failure adds nothing, because keys
    already stored are left out.
    """
    from ..plans.build import encode_tiles

    def batch(df, batch_id):
        one = df.select("sample_id", "chr", "start_bp", "end_bp", "matrix").dropDuplicates(["sample_id", "chr", "start_bp"])
        store.ingest(encode_tiles(one, encode, dim=dim))

    return (tiles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


class CodeState:
    """Versions of the running codebook, one folder per processed batch."""

    SCHEMA = "code int, ema_count double, ema_sum array<double>, vec array<double>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self, n: int) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/v={n}")

    def write(self, df: DataFrame, n: int):
        df.select("code", "ema_count", "ema_sum", "vec").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/v={n}")

    def start(self, codebook: DataFrame):
        """Version 0 from an initial codebook: count 1 and the code's own vector."""
        v = F.col("vec").cast("array<double>")
        self.write(codebook.select("code", F.lit(1.0).alias("ema_count"), v.alias("ema_sum"), v.alias("vec")), 0)


def code_stream(tokens: DataFrame, state: CodeState, key, dim: int, checkpoint: str, gamma: float = C.EMA_GAMMA):
    """Codebook refresh per mini-batch: batch n reads version n and writes version n + 1.

    Running a batch again rewrites the same version from the same input.
    """
    def batch(df, batch_id):
        old = state.version(batch_id)
        assigned = codes.assign_codes(df, old.select("code", "vec"), key)
        state.write(codes.ema_update(old, assigned, dim, gamma), batch_id + 1)

    return (tokens.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def pending(requested: DataFrame, store: Store) -> DataFrame:
    """Requested (sample, chromosome) work without stored fingerprints."""
    done = store.read("window_fingerprints").select("sample_id", F.col("chr").alias("chrom"))
    return tables.not_done(requested, done)
