"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without it gets a temporary one."""
    conf = spark.sparkContext.getConf()
    place = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
