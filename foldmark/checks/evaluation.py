"""Retrieval-quality metrics."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import vectors as V
from ..operators import evaluation as E
from ..operators import blocks
from ..operators.pair_auc import group_auc
from .base import define, r6, registry

QUERIES, ORACLES, register = registry()

define("z", """
SELECT vec_id AS id, label, list_transform(CAST(embedding AS DOUBLE[]),
  lambda x: x/sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v
FROM embeddings""")
define("zz", """
SELECT a.id, a.label, b.id AS rid, b.label AS rlabel, list_dot_product(a.v, b.v) AS score FROM z a, z b""", ["z"])
define("ranked", """
SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rid) AS rank FROM zz WHERE id <> rid""", ["zz"])


def _rows(fx):
    return fx.fingerprints.select("id", "label", "fingerprint")


def _recall(ks):
    cols = ", ".join(f"round(avg(CASE WHEN hit <= {k} THEN 1.0E0 ELSE 0.0E0 END), 6) AS recall_{k}" for k in ks)
    return f"""SELECT {cols} FROM (
  SELECT id, min(CASE WHEN label = rlabel THEN rank END) AS hit FROM ranked GROUP BY id)"""


@register("recall_at_k", _recall((1, 3, 5, 10, 20)), ["ranked"])
def recall_at_k(fx):
    out = E.recall_at(E.neighbours(_rows(fx), 20))
    return out.select(*[r6(c) for c in out.columns])


_AP = """
SELECT round(avg(ap), 6) AS mean_ap FROM (
  SELECT id, sum(CASE WHEN label = rlabel THEN c*1.0E0/rk END)/sum(CASE WHEN label = rlabel THEN 1 ELSE 0 END) AS ap
  FROM (SELECT *, row_number() OVER w AS rk,
      sum(CASE WHEN label = rlabel THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS c
    FROM (SELECT id, label, rid, rlabel, CASE WHEN id = rid THEN -2 ELSE score END AS s FROM zz {skip})
    WINDOW w AS (PARTITION BY id ORDER BY s DESC, rid)) GROUP BY id)"""


@register("mean_ap", _AP.format(skip=""), ["zz"])
def mean_ap(fx):
    return E.mean_average_precision(_rows(fx)).select(r6("mean_ap"))


@register("mean_ap_others", _AP.format(skip="WHERE id <> rid"), ["zz"])
def mean_ap_others(fx):
    return E.mean_average_precision(_rows(fx), include_self=False).select(r6("mean_ap"))


@register("knn5_accuracy", """
SELECT round(avg(CASE WHEN label = p THEN 1.0E0 ELSE 0.0E0 END), 6) AS knn_accuracy FROM (
  SELECT id, label, rlabel AS p, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, rlabel) AS rn FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rid) AS rk FROM zz)
  WHERE rk <= 5 GROUP BY id, label, rlabel) WHERE rn = 1""", ["zz"])
def knn5_accuracy(fx):
    return E.knn_accuracy(E.neighbours(_rows(fx), 5, exclude_self=False)).select(r6("knn_accuracy"))


define("dist", """
SELECT id, label, rlabel, sum(1 - score) AS d, count(*) AS n FROM zz WHERE id <> rid GROUP BY 1,2,3""", ["zz"])
define("sil", """
SELECT id, label, CASE WHEN a IS NULL THEN 0.0E0 ELSE (b - a)/greatest(a, b) END AS silhouette FROM (
  SELECT id, label, max(CASE WHEN label = rlabel THEN d/n END) AS a, min(CASE WHEN label <> rlabel THEN d/n END) AS b
  FROM dist GROUP BY 1,2)""", ["dist"])


@register("silhouette", "SELECT round(avg(silhouette), 6) + 0.0E0 AS silhouette FROM sil", ["sil"])
def silhouette(fx):
    return E.silhouette_samples(_rows(fx)).agg(F.avg("silhouette").alias("silhouette")).select(r6("silhouette"))


@register("silhouette_samples", "SELECT id, label, round(silhouette, 6) + 0.0E0 AS silhouette FROM sil", ["sil"])
def silhouette_samples(fx):
    return E.silhouette_samples(_rows(fx)).select("id", "label", r6("silhouette"))


@register("silhouette_by_class", """
SELECT label, round(avg(silhouette), 6) + 0.0E0 AS silhouette FROM sil GROUP BY 1""", ["sil"])
def silhouette_by_class(fx):
    return (E.silhouette_samples(_rows(fx)).groupBy("label").agg(F.avg("silhouette").alias("silhouette"))
            .select("label", r6("silhouette")))


@register("class_matrix", """
SELECT label AS label_a, rlabel AS label_b, round(avg(score), 6) + 0.0E0 AS mean_similarity FROM zz GROUP BY 1,2""",
          ["zz"])
def class_matrix(fx):
    return E.class_matrix(_rows(fx)).select("label_a", "label_b", r6("mean_similarity"))


@register("class_matrix_others", """
SELECT label AS label_a, rlabel AS label_b, round(avg(score), 6) + 0.0E0 AS mean_similarity
FROM zz WHERE id <> rid GROUP BY 1,2""", ["zz"])
def class_matrix_others(fx):
    return E.class_matrix(_rows(fx), include_self=False).select("label_a", "label_b", r6("mean_similarity"))


_GAP = """
SELECT round(a, 6) + 0.0E0 AS intra_mean, round(b, 6) + 0.0E0 AS inter_mean, round(a - b, 6) + 0.0E0 AS gap FROM (
  SELECT avg(CASE WHEN label = rlabel THEN score END) AS a, avg(CASE WHEN label <> rlabel THEN score END) AS b
  FROM zz {skip})"""


@register("intra_inter", _GAP.format(skip="WHERE id <> rid"), ["zz"])
def intra_inter(fx):
    return E.intra_inter(_rows(fx)).select(r6("intra_mean"), r6("inter_mean"), r6("gap"))


@register("intra_inter_with_self", _GAP.format(skip=""), ["zz"])
def intra_inter_with_self(fx):
    return E.intra_inter(_rows(fx), include_self=True).select(r6("intra_mean"), r6("inter_mean"), r6("gap"))


# 80 edges from -0.2 to 1: 79 bins of width 1.2/79
@register("similarity_histogram", """
SELECT kind, bin, n, round(n/(sum(n) OVER (PARTITION BY kind) * (1.2E0/79)), 6) AS density FROM (
  SELECT k.kind, CAST(b.bin AS INTEGER) AS bin, count(p.score) AS n
  FROM (SELECT unnest(['intra', 'inter']) AS kind) k CROSS JOIN (SELECT unnest(range(1, 80)) AS bin) b
  LEFT JOIN (SELECT CASE WHEN label = rlabel THEN 'intra' ELSE 'inter' END AS kind, score,
      least(79, 1 + CAST(floor((score + 0.2)/(1.2E0/79)) AS BIGINT)) AS bin
    FROM zz WHERE id <> rid AND score >= -0.2 AND score <= 1.0) p ON p.kind = k.kind AND p.bin = b.bin
  GROUP BY 1,2)""", ["zz"])
def similarity_histogram(fx):
    e = E.edges(E.EDGES_80)
    h = blocks.similarity_histogram(_rows(fx), "label", e, eps=E.PLAIN)
    return E.density(h, float(np.diff(e).mean())).select("kind", "bin", "n", r6("density"))


# 60 edges: 59 bins
@register("similarity_histogram_60", ORACLES["similarity_histogram"][0].replace("1.2E0/79", "1.2E0/59").replace("range(1, 80)", "range(1, 60)")
          .replace("least(79,", "least(59,"), ["zz"])
def similarity_histogram_60(fx):
    e = E.edges(E.EDGES_60)
    h = blocks.similarity_histogram(_rows(fx), "label", e, eps=E.PLAIN)
    return E.density(h, float(np.diff(e).mean())).select("kind", "bin", "n", r6("density"))


@register("recall_within_class", """
SELECT c.label, c.n, round(r.recall_5, 6) AS recall_5
FROM (SELECT label, count(*) AS n FROM z GROUP BY 1) c LEFT JOIN (
  SELECT label, avg(CASE WHEN hit <= 5 THEN 1.0E0 ELSE 0.0E0 END) AS recall_5 FROM (
    SELECT id, label, min(rank) AS hit FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rid) AS rank
      FROM zz WHERE id <> rid AND label = rlabel) GROUP BY 1,2) GROUP BY 1) r USING (label)""", ["zz", "z"])
def recall_within_class(fx):
    return E.recall_within_class(_rows(fx)).select("label", "n", r6("recall_5"))


@register("random_baseline", """
SELECT count(DISTINCT label) AS n_cell_types, count(*) AS n_windows,
  round(1 - pow(1 - 1.0E0/count(DISTINCT label), 5), 6) AS random_recall5 FROM embeddings""")
def random_baseline(fx):
    return (_rows(fx).agg(F.count_distinct("label").alias("n_cell_types"), F.count(F.lit(1)).alias("n_windows"))
            .withColumn("random_recall5", L.random_recall(F.col("n_cell_types")))
            .select("n_cell_types", "n_windows", r6("random_recall5")))


@register("classifier_accuracy", """
SELECT round(avg(CASE WHEN list_position(l, list_max(l)) - 1 = label THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy,
  count(*) AS n FROM (SELECT label, embedding[1:10] AS l FROM embeddings)""")
def classifier_accuracy(fx):
    scored = fx.fingerprints.select("label", F.slice("fingerprint", 1, 10).alias("logits"))
    return E.classifier_accuracy(scored, "logits", "label").select(r6("accuracy"), "n")


# every two windows at a locus; a pair is of the same class when the labels agree
define("pairs", """
SELECT CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS same, round(list_dot_product(a.v, b.v), 6) AS score
FROM z a JOIN z b ON a.id % 25 = b.id % 25 AND a.id < b.id""", ["z"])
_AUC = """
SELECT round(sum(p*(below + q/2.0E0))/(sum(p)*sum(q)), 6) AS auc FROM (
  SELECT *, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT score, sum(same) AS p, sum(1 - same) AS q FROM {pairs} GROUP BY 1))"""


_LOCUS = ["chr", "start_bp"]


@register("pair_auc", _AUC.format(pairs="pairs"), ["pairs"])
def pair_auc(fx):
    return group_auc(fx.fingerprints, _LOCUS, digits=6).select(r6("auc"))


@register("pca_2d")
def pca_2d(fx):
    out = E.principal_components(_rows(fx), 2)
    return out.select("id", F.get("pc", F.lit(0)).alias("pc1"), F.get("pc", F.lit(1)).alias("pc2"))


define("centre", """
SELECT list(m ORDER BY p) AS m FROM (SELECT p, avg(CAST(embedding[p] AS DOUBLE)) AS m
  FROM embeddings, (SELECT unnest(range(1, 65)) AS p) GROUP BY p)""")


# all axes keep lengths and angles, so the norms need no axes, whatever their signs
@register("pca_row_norms", """
SELECT vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), m), lambda x: (x[1] - x[2])*(x[1] - x[2])))), 6)
  AS norm FROM embeddings, centre""", ["centre"])
def pca_row_norms(fx):
    out = E.principal_components(_rows(fx), 64)
    return out.select("id", F.round(V.norm(F.col("pc")), 6).alias("norm"))


# total variance and the largest eigenvalue by what it does to its own axis
@register("pca_variances", """
SELECT round(sum(v), 6) AS total FROM (SELECT var_samp(CAST(embedding[p] AS DOUBLE)) AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS p) GROUP BY p)""")
def pca_variances(fx):
    _, _, variance = E.principal_axes(_rows(fx))
    return fx.spark.createDataFrame([(float(variance.sum()),)], "total double").select(r6("total"))


define("centred_pairs", """
SELECT same, round(list_dot_product(a, b)/((sqrt(list_dot_product(a, a)) + 1e-8)*(sqrt(list_dot_product(b, b)) + 1e-8)), 9) AS score FROM (
  SELECT CASE WHEN x.label = y.label THEN 1 ELSE 0 END AS same,
    list_transform(list_zip(CAST(x.embedding AS DOUBLE[]), m), lambda t: t[1] - t[2]) AS a,
    list_transform(list_zip(CAST(y.embedding AS DOUBLE[]), m), lambda t: t[1] - t[2]) AS b
  FROM embeddings x JOIN embeddings y ON x.vec_id % 25 = y.vec_id % 25 AND x.vec_id < y.vec_id, centre)""", ["centre"])


@register("pca_auc_full", _AUC.format(pairs="centred_pairs"), ["centred_pairs"])
def pca_auc_full(fx):
    """AUC after projection on all axes: that of the centred vectors."""
    mean, axes, _ = E.principal_axes(_rows(fx))
    return group_auc(fx.fingerprints, _LOCUS, [len(mean)], axes=axes, mean=mean, digits=9).select(r6("auc"))


@register("pca_auc_by_dimension")
def pca_auc_by_dimension(fx):
    """AUC of the cosine of the vectors at a locus after reduction to d dimensions."""
    return E.auc_by_dimension(fx.fingerprints, _LOCUS, (8, 16, 24, 32, 64)).select("dims", r6("auc"))


_KNN = ORACLES["knn5_accuracy"][0]
_SIL = ORACLES["silhouette"][0]


@register("quality_report", f"""
SELECT *, CASE WHEN recall_5 >= 0.8 THEN 'EXCELLENT — publication ready' WHEN recall_5 >= 0.65 THEN
    'GOOD — suitable for retrieval' WHEN recall_5 >= 0.45 THEN 'FAIR — usable but needs improvement'
    ELSE 'POOR — needs more training' END AS verdict,
  CASE WHEN recall_5 >= 0.7 THEN 'EXCELLENT' WHEN recall_5 >= 0.5 THEN 'GOOD' WHEN recall_5 >= 0.3 THEN 'FAIR'
    ELSE 'POOR' END AS grade
FROM ({_recall((1, 3, 5, 10, 20))}), ({_KNN}), ({_SIL}), ({_AP.format(skip="")}), ({_GAP.format(skip="WHERE id <> rid")}),
  ({ORACLES["random_baseline"][0]})""", ["ranked", "zz", "sil"])
def quality_report(fx):
    out = E.quality_report(_rows(fx))
    return out.select(*[r6(c) if t == "double" else c for c, t in out.dtypes])


# some vectors are missing, some are NaN: they take no part in any metric
define("z_gaps", "SELECT * FROM z WHERE id % 11 <> 3 AND id % 13 <> 5", ["z"])
define("zz_gaps", """
SELECT a.id, a.label, b.id AS rid, b.label AS rlabel, list_dot_product(a.v, b.v) AS score FROM z_gaps a, z_gaps b""", ["z_gaps"])


def _gaps(fx):
    v = F.col("fingerprint")
    nan = F.transform(v, lambda x: F.lit(float("nan")).cast("float"))
    return _rows(fx).withColumn(
        "fingerprint", F.when(F.col("id") % 11 == 3, F.lit(None)).when(F.col("id") % 13 == 5, nan).otherwise(v))


@register("class_matrix_gaps", ORACLES["class_matrix"][0].replace("FROM zz", "FROM zz_gaps"), ["zz_gaps"])
def class_matrix_gaps(fx):
    return E.class_matrix(_gaps(fx)).select("label_a", "label_b", r6("mean_similarity"))


@register("intra_inter_gaps", _GAP.format(skip="WHERE id <> rid").replace("FROM zz", "FROM zz_gaps"), ["zz_gaps"])
def intra_inter_gaps(fx):
    return E.intra_inter(_gaps(fx)).select(r6("intra_mean"), r6("inter_mean"), r6("gap"))


define("dist_gaps", """
SELECT id, label, rlabel, sum(1 - score) AS d, count(*) AS n FROM zz_gaps WHERE id <> rid GROUP BY 1,2,3""", ["zz_gaps"])
define("sil_gaps", """
SELECT id, label, CASE WHEN a IS NULL THEN 0.0E0 ELSE (b - a)/greatest(a, b) END AS silhouette FROM (
  SELECT id, label, max(CASE WHEN label = rlabel THEN d/n END) AS a, min(CASE WHEN label <> rlabel THEN d/n END) AS b
  FROM dist_gaps GROUP BY 1,2)""", ["dist_gaps"])


@register("silhouette_gaps", "SELECT id, label, round(silhouette, 6) + 0.0E0 AS silhouette FROM sil_gaps", ["sil_gaps"])
def silhouette_gaps(fx):
    return E.silhouette_samples(_gaps(fx)).select("id", "label", r6("silhouette"))


@register("mean_ap_gaps", _AP.format(skip="").replace("FROM zz", "FROM zz_gaps"), ["zz_gaps"])
def mean_ap_gaps(fx):
    return E.mean_average_precision(_gaps(fx)).select(r6("mean_ap"))


@register("average_precision", _AP.format(skip="").replace(
    "SELECT round(avg(ap), 6) AS mean_ap FROM", "SELECT id, round(ap, 6) AS ap FROM"), ["zz"])
def average_precision(fx):
    return E.average_precision(_rows(fx)).select("id", r6("ap"))


define("ranked_gaps", """
SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rid) AS rank FROM zz_gaps WHERE id <> rid""", ["zz_gaps"])


@register("quality_report_gaps", f"""
SELECT *, CASE WHEN recall_5 >= 0.8 THEN 'EXCELLENT — publication ready' WHEN recall_5 >= 0.65 THEN
    'GOOD — suitable for retrieval' WHEN recall_5 >= 0.45 THEN 'FAIR — usable but needs improvement'
    ELSE 'POOR — needs more training' END AS verdict,
  CASE WHEN recall_5 >= 0.7 THEN 'EXCELLENT' WHEN recall_5 >= 0.5 THEN 'GOOD' WHEN recall_5 >= 0.3 THEN 'FAIR'
    ELSE 'POOR' END AS grade
FROM ({_recall((1, 3, 5, 10, 20)).replace("FROM ranked", "FROM ranked_gaps")}), ({_KNN.replace("FROM zz", "FROM zz_gaps")}),
  ({_SIL.replace("FROM sil", "FROM sil_gaps")}), ({_AP.format(skip="").replace("FROM zz", "FROM zz_gaps")}),
  ({_GAP.format(skip="WHERE id <> rid").replace("FROM zz", "FROM zz_gaps")}), ({ORACLES["random_baseline"][0]})""",
          ["ranked_gaps", "zz_gaps", "sil_gaps"])
def quality_report_gaps(fx):
    """Rows without a vector count as windows and as classes, and in nothing else."""
    out = E.quality_report(_gaps(fx))
    return out.select(*[r6(c) if t == "double" else c for c, t in out.dtypes])
