"""Full rankings by a sweep against plain numpy: blocks of every size, ties, gaps, labels of one member, no label."""

import os

import numpy as np
import pytest

from foldmark.operators import codes as K
from foldmark.operators import evaluation as E
from foldmark.operators import sweep
from foldmark.operators import tables as T
from foldmark.plans import build

SCHEMA = "id long, label string, fingerprint array<double>"


def plain(rows, include_self):
    unit = {i: np.array(v) / (np.linalg.norm(v) + 1e-300) for i, _, v in rows}
    out = {}
    for i, label, _ in rows:
        order = sorted((r for r in rows if r[0] != i), key=lambda r: (-round(float(unit[i] @ unit[r[0]]), 12), r[0]))
        match = [r[1] == label for r in order] + [True] * include_self
        hits = np.cumsum(match)
        out[i] = float((hits / np.arange(1, len(match) + 1))[match].sum() / sum(match)) if any(match) else None
    return out


def corpus():
    rng = np.random.default_rng(4)
    rows = [(k, f"L{k % 5}", [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(150)]  # many ties and zero vectors
    rows += [(500 + k, "hot", [float(x) for x in rng.normal(size=4)]) for k in range(120)]
    rows += [(900, "alone", [1.0, 0.0, 0.0, 0.0]), (901, None, [1.0, 1.0, 0.0, 0.0]), (902, None, [0.5, 0.5, 0.0, 0.0])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("include_self", [True, False])
@pytest.mark.parametrize("limits", [{}, {"block_rows": 16, "block_hits": 700}])
def test_average_precision(spark, include_self, limits):
    rows = corpus()
    gaps = [(2000, "hot", None), (2001, "hot", [float("nan")] * 4), (2002, "L1", [1.0, None, 0.0, 0.0]), (2003, "L1", [1e200, 1e200, 0.0, 0.0])]
    df = spark.createDataFrame([(int(i), l, v) for i, l, v in rows + gaps], SCHEMA).repartition(5)
    got = {r["id"]: r["ap"] for r in E.average_precision(df, include_self=include_self, **limits).collect()}
    want = plain(rows, include_self)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == (None if want[i] is None else pytest.approx(want[i])), i


def test_nearest_rows_of_the_sweep(spark):
    rows = corpus()
    df = spark.createDataFrame([(int(i), l, v) for i, l, v in rows], SCHEMA).repartition(3)
    got = {r["id"]: [(x["ref_key"], x["ref_label"]) for x in r["near"]] for r in sweep.ranking(df, top=4, block_rows=20, block_hits=900).collect()}
    unit = {i: np.array(v) / (np.linalg.norm(v) + 1e-300) for i, _, v in rows}
    for i, _, _ in rows:
        order = sorted(rows, key=lambda r: (-round(float(unit[i] @ unit[r[0]]), 12), r[0]))[:4]
        assert got[i] == [(r[0], r[1]) for r in order]
    assert sweep.ranking(df.limit(0), top=3).count() == 0


def test_class_metrics_leave_out_missing_vectors(spark):
    rows = [(1, "x", [1.0, 0.0]), (2, "x", [1.0, 0.0]), (3, "y", [0.0, 1.0]), (4, "x", None), (5, "y", [float("nan"), 0.0]),
            (6, "z", None), (7, "y", [0.0, None])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r[0], r[1]): r[2] for r in E.class_matrix(df, dim=2).collect()}
    assert got == {("x", "x"): 1.0, ("x", "y"): 0.0, ("y", "x"): 0.0, ("y", "y"): 1.0}
    gap = E.intra_inter(df, dim=2).first()
    assert (gap["intra_mean"], gap["inter_mean"]) == (1.0, 0.0)
    assert {r["id"]: r["silhouette"] for r in E.silhouette_samples(df, dim=2).collect()} == {1: 1.0, 2: 1.0, 3: 0.0}
    at = spark.createDataFrame([("c", 0, 9, v) for _, _, v in rows if v != [0.0, 1.0]], "chr string, start_bp long, end_bp long, fingerprint array<double>")
    one = T.locus_centroids(at, 2).first()
    assert (one["n_samples"], one["centroid"]) == (2, [1.0, 0.0])


def test_principal_axes_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 1e4
    rows = [(k, "a", [float(c) for c in v]) for k, v in enumerate(x)] + [(900, "a", None), (901, "a", [float("inf")] * 6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    mean, axes, variance = E.principal_axes(df)
    cov = np.cov(x.T)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(variance, np.linalg.eigvalsh(cov)[::-1], rtol=1e-6)
    assert np.allclose(cov @ axes.T, axes.T * variance, atol=1e-4) and (axes[np.arange(6), np.abs(axes).argmax(axis=1)] > 0).all()
    got = {r["id"]: r["pc"] for r in E.principal_components(df, 2).collect()}
    assert got[900] is None and got[901] is None and np.allclose(got[7], (x[7] - mean) @ axes[:2].T)
    assert np.allclose(got[3], E.principal_components(df, 6).where("id = 3").first()["pc"][:2])  # a slice
    assert E.second_moments(df.limit(0))[0] == 0


def test_auc_of_close_scores_and_missing_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.random() < 0.3), float(0.95 + rng.integers(0, 400) / 8000)) for _ in range(1500)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    df = spark.createDataFrame(rows + [(1, None), (0, float("nan"))], "same int, score double").repartition(6)
    assert E.pair_auc(df).first()["auc"] == pytest.approx(want)
    assert E.pair_auc(df.where("same = 1")).first()["auc"] is None


def test_seeded_codebook_spreads_over_far_groups(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 3)) * 50
    rows = [(k, [float(x) for x in centres[0 if k % 3 else k % 6] + rng.normal(size=3) * 0.1]) for k in range(600)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, token array<double>").repartition(4)
    near = [c for k, c in enumerate(centres) if k in (0, 3)]
    book = [r["vec"] for r in K.seed_codebook(df, 2, key=["id"]).collect()]
    assert len(book) == 2 and all(min(np.linalg.norm(np.array(b) - c) for b in book) < 1 for c in near)
    again = [r["vec"] for r in K.seed_codebook(df.repartition(9), 2, key=["id"]).collect()]
    assert sorted(book) == sorted(again)
    few = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [2.0])], "id long, token array<double>")
    assert sorted(r["vec"] for r in K.seed_codebook(few, 5, key=["id"]).collect()) == [[1.0], [2.0]]


def test_split_keeps_null_strata_and_hot_ones(spark):
    rows = [(k, "hot" if k % 3 else None) for k in range(900)] + [(5000, "one")]
    df = spark.createDataFrame(rows, "id long, s string").repartition(4)
    got = T.stratified_split(df, "s", "id").collect()
    n = {s: (sum(r["s"] == s for r in got), sum(r["s"] == s and r["split"] == "val" for r in got)) for s in (None, "hot", "one")}
    assert n == {None: (300, 30), "hot": (600, 60), "one": (1, 1)}
    numbered = T.dense_numbering(spark.createDataFrame([("a", None), ("a", "c"), (None, "c")], "x string, y string"), ["x", "y"])
    assert sorted(r["_row"] for r in numbered.collect()) == [1, 2, 3]


def test_combine_moves_no_matrix(spark):
    rows = [(f"S{k % 3}", "chr1", k, k + 8, [float(k)] * 4) for k in range(60)] + [(None, "chr1", 0, 8, [0.0] * 4)]
    tiles = spark.createDataFrame(rows, "sample_id string, chr string, start_bin long, end_bin long, matrix array<float>")
    out = build.combine(tiles, registry=spark.createDataFrame([("S1", "micro_c"), ("S2", "odd")], "sample_id string, assay string"))
    got = out.collect()
    assert len(got) == 61 and {(r["sample_id"], r["cell_idx"], r["assay_id"]) for r in got} == {
        (None, 0, 0), ("S0", 1, 0), ("S1", 2, 1), ("S2", 3, 0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_average_precision_of_more_references_than_a_batch(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(k), f"L{k % 3}", [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(200, 4)))]
    rows += [(300 + k, f"L{k % 3}", [1.0, 2.0, -1.0, 0.5]) for k in range(90)]  # copies: ties in every batch
    block = sweep._Block(3, 500)
    monkeypatch.setattr(sweep, "_BATCH_ROWS", 37)
    rows.sort(key=lambda r: (r[1], r[0]))
    ids, labels, v = np.array([r[0] for r in rows]), [r[1] for r in rows], np.array([r[2] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    block.add(sweep.QUERY, ids, labels, v)
    for a in range(0, len(rows), 50):
        block.add(sweep.REFERENCE, ids[a:a + 50], labels[a:a + 50], v[a:a + 50])
    got, near = {}, {}
    for own, _, ap, (row, ref, _, _) in block.results(True):
        got |= dict(zip(own.tolist(), ap, strict=True))
        near |= {int(i): ref[row == k].tolist() for k, i in enumerate(own)}
    want = plain(rows, True)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    assert near[300] == [300, 301, 302]


def test_a_row_is_shuffled_once_a_block(spark):
    """A copy for every block that holds positives made 40 copies a row of this label."""
    df = spark.createDataFrame([(int(k), "hot", [1.0, float(k)]) for k in range(200)], SCHEMA)
    side = df.select("id", "label", df.fingerprint.alias("vector"))
    parts = min(4, 2 * spark.sparkContext.defaultParallelism)
    assert sweep._dealt(side, "label", "id", 32_768).count() == 200 * (parts + 1)


def test_quality_report_is_one_plan(spark, monkeypatch):
    """The sweep was written while the plan was built, and neighbours were exploded and shuffled three times."""
    df = spark.createDataFrame([(int(i), l, v) for i, l, v in corpus()], SCHEMA)
    monkeypatch.setattr(E.V, "sum_vectors", lambda v, dim, real=E.V.sum_vectors: real(v, 4))
    folder = spark.conf.get("spark.checkpoint.dir", None)
    made = set(os.listdir(folder.removeprefix("file://"))) if folder else set()
    out = E.quality_report(df)
    counts = out.select("n_windows", "n_cell_types")
    assert counts.first()[:] == (len(corpus()), 7)
    assert "MapInArrow" not in counts._jdf.queryExecution().executedPlan().toString()
    got = out.first()
    near = E.neighbours(df, 20)
    recall, knn = E.recall_at(near).first(), E.knn_accuracy(E.neighbours(df, 5, exclude_self=False)).first()
    assert [got[c] for c in recall.asDict()] == pytest.approx(list(recall)) and got["knn_accuracy"] == pytest.approx(knn[0])
    assert set(os.listdir(folder.removeprefix("file://")) if folder else ()) == made
