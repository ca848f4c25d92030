"""The dealt operators over their whole tables, and their oracles where SQL can say it."""

from pyspark.sql import functions as F

from . import chat, gru_lm, line_clean, lz_prints, merkle, mixing, packing, pii, repair, secret_scan, toxicity
from .common import documents, fold
from .exact_dedup import exact_groups
from .near_dedup import near_groups


def op1_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (docs.withColumn("score", toxicity.score(model, F.col("text")))
            .withColumn("threshold", toxicity.threshold(model, docs))
            .select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                    (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold",
                    (F.col("score") >= F.col("threshold")).alias("flagged")))


def op2_secrets(spark, sf_dir):
    return secret_scan.scan(documents(spark, sf_dir))


def op3_gru_lm(spark, sf_dir):
    return gru_lm.score(documents(spark, sf_dir))


def op4_chat(spark, sf_dir):
    return chat.rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_line_cleaning(spark, sf_dir):
    return line_clean.clean(documents(spark, sf_dir), with_text=False)


def op6_packing(spark, sf_dir):
    return packing.packed(documents(spark, sf_dir))


def op7_minhash(spark, sf_dir):
    return near_groups(documents(spark, sf_dir))


def op8_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))


def op9_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


def op10_pii(spark, sf_dir):
    return pii.replaced(documents(spark, sf_dir).select("doc_id", "text"))


def op11_repair(spark, sf_dir):
    original = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.report(original, repair.damaged(original))


def op12_lz_prints(spark, sf_dir):
    return lz_prints.compared(documents(spark, sf_dir))


def op13_merkle(spark, sf_dir):
    return merkle.manifest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_gru_lm, op4_chat, op5_line_cleaning, op6_packing, op7_minhash,
                                   op8_exact_dedup, op9_mixing, op10_pii, op11_repair, op12_lz_prints, op13_merkle)}

ORACLES = {
    "op4_chat": chat.ORACLE,
    "op5_line_cleaning": line_clean.ORACLE,
    "op8_exact_dedup": r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
      FROM documents)
WINDOW g AS (PARTITION BY body)""",
    "op9_mixing": mixing.ORACLE,
    "op11_repair": repair.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
