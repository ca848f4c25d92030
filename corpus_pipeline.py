"""The corpus pipeline: five stages over ``documents``, each written as a table and read by the next."""

from pyspark.sql import functions as F

from foldmark.llm import mixing, packing, toxicity
from foldmark.llm.common import apart, documents, stored
from foldmark.llm.exact_dedup import without_copies
from foldmark.llm.near_dedup import one_of_each


def drop_toxic(spark, docs, sf_dir):
    """Documents whose score reaches their language's threshold go.

    The classifier learns from ``labels`` and the texts of ``docs``. Null texts count as empty; columns may have any name.
    """
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs, restored = apart(docs, "doc_id", "text", "lang")
    return (docs.withColumn("_toxic_score", toxicity.score(model, F.col("text")))
            .where(F.col("_toxic_score") < toxicity.threshold(model, docs)).transform(restored))


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts (A-Z lower-cased) one row stays."""
    return without_copies(docs)


def near_dedup(spark, docs, sf_dir):
    """Of each near-duplicate class the document with the lowest id stays."""
    return one_of_each(docs)


def mix(spark, docs, sf_dir):
    """Every document as often as the mix to the target weights takes it."""
    return mixing.mixed_rows(docs)


def pack(spark, docs, sf_dir):
    """Pieces of all documents and their places in sequences of 1024 ids."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup),
          ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None  # scores of a trained model and MinHash classes have no SQL form


def run(spark, sf_dir):
    """All stages over ``documents``; returns the last stage's rows."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs
