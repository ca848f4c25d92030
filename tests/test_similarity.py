"""The block engine and what is built on it, against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmark.operators import blocks
from foldmark.operators import evaluation as E
from foldmark.operators import replicates as R
from foldmark.operators import rollups
from foldmark.operators import similarity as S

RNG = np.random.default_rng(7)
N, DIM = 120, 6
X = RNG.normal(size=(N, DIM)).astype(np.float32)
LABEL = np.where(np.arange(N) < 40, 0, RNG.integers(0, 5, N))  # label 0 holds over a third


def frame(spark, x=X, label=LABEL):
    return spark.createDataFrame([(i, int(lab), [float(v) for v in row]) for i, (row, lab) in enumerate(zip(x, label))],
                                 "id long, label int, fingerprint array<float>")


def unit(x, eps=0.0):
    x = x.astype(np.float64)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + eps)


COS = unit(X) @ unit(X).T


@pytest.mark.parametrize("rows", [16, 50, 4096])
def test_top_matches_any_block_size(spark, rows):
    df = frame(spark)
    got = E.neighbours(df, 4, block_rows=rows).select("id", "ref_key", "rank").collect()
    assert len(got) == N * 4
    s = COS.copy()
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1, kind="stable")[:, :4]
    assert {(r["id"], r["rank"]): r["ref_key"] for r in got} == {
        (i, k + 1): int(want[i, k]) for i in range(N) for k in range(4)}


def test_hot_group_is_split(spark):
    """Within-label search with small blocks: the large label spans many blocks, nothing is lost."""
    got = E.neighbours(frame(spark), 3, within_label=True, block_rows=10).collect()
    for r in got:
        peers = [j for j in np.nonzero(LABEL == r["label"])[0] if j != r["id"]]
        order = sorted(peers, key=lambda j: (-round(COS[r["id"], j], 12), j))
        assert order[r["rank"] - 1] == r["ref_key"]


def test_ties_go_to_the_smaller_key(spark):
    x = np.repeat(X[:3], 4, axis=0)
    df = frame(spark, x, np.zeros(12, int))
    got = E.neighbours(df, 2, exclude_self=False, block_rows=5).where("id = 7").orderBy("rank").collect()
    assert [r["ref_key"] for r in got] == [4, 5]


def test_key_types_must_agree(spark):
    a = frame(spark).withColumn("k", F.lit(1))
    with pytest.raises(TypeError):
        blocks.top_matches(a, a.withColumn("k", F.lit(1).cast("long")), 1, keys=["k"])


def test_best_per_label(spark):
    df = frame(spark)
    got = blocks.best_per_label(df.select("id", "fingerprint"), df, "label", rows=30).collect()
    cos = unit(X, 1e-8) @ unit(X, 1e-8).T
    assert len(got) == N * 5
    for r in got:
        j = np.nonzero(LABEL == r["label"])[0]
        assert r["score"] == pytest.approx(cos[r["id"], j].max(), abs=1e-9)
        assert r["ref_key"] == j[np.round(cos[r["id"], j], 12).argmax()]


def test_histogram_counts_every_ordered_pair(spark):
    edges = np.linspace(-1, 1, 11)
    got = {(r["kind"], r["bin"]): r["n"]
           for r in blocks.similarity_histogram(frame(spark), "label", edges, rows=25, eps=1e-300).collect()}
    same = LABEL[:, None] == LABEL[None, :]
    off = ~np.eye(N, dtype=bool)
    for kind, mask in (("intra", same & off), ("inter", ~same)):
        want = np.histogram(np.round(COS[mask], 12), edges)[0]
        assert [got[kind, b + 1] for b in range(10)] == list(want)


def test_average_precision_by_definition(spark):
    got = {r["id"]: r["ap"] for r in E.average_precision(frame(spark), block_rows=50).collect()}
    for i in range(N):
        s = COS[i].copy()
        s[i] = -2
        order = sorted(range(N), key=lambda j: (-round(s[j], 12), j))
        same = np.array([LABEL[j] == LABEL[i] for j in order], float)
        assert got[i] == pytest.approx((np.cumsum(same) / np.arange(1, N + 1) * same).sum() / same.sum())


def test_sums_replace_pairs(spark):
    df = frame(spark)
    same = LABEL[:, None] == LABEL[None, :]
    off = ~np.eye(N, dtype=bool)
    r = E.intra_inter(df, dim=DIM).first()
    assert r["intra_mean"] == pytest.approx(COS[same & off].mean())
    assert r["inter_mean"] == pytest.approx(COS[~same].mean())
    m = {(x["label_a"], x["label_b"]): x["mean_similarity"] for x in E.class_matrix(df, dim=DIM).collect()}
    for a in range(5):
        for b in range(5):
            assert m[a, b] == pytest.approx(COS[np.ix_(LABEL == a, LABEL == b)].mean())


def test_silhouette_by_pairs_and_single_member(spark):
    label = LABEL.copy()
    label[-1] = 9
    got = {r["id"]: r["silhouette"]
           for r in E.silhouette_samples(frame(spark, X, label), dim=DIM, block_rows=40).collect()}
    d = 1 - COS
    assert got[N - 1] == 0.0
    for i in range(N - 1):
        own = [j for j in np.nonzero(label == label[i])[0] if j != i]
        a = d[i, own].mean()
        b = min(d[i, label == c].mean() for c in set(label) - {label[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_within_class_recall_is_one(spark):
    assert {r["recall_5"] for r in E.recall_within_class(frame(spark)).collect()} == {1.0}


def test_pair_auc(spark):
    y, s = RNG.integers(0, 2, 200), np.round(RNG.normal(size=200), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "same int, score double")
    p, q = s[y == 1], s[y == 0]
    want = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
    assert E.pair_auc(df).first()["auc"] == pytest.approx(want)


def windows(spark):
    rows = [("q", "chr1", 0, 10, [1.0, 0.0]), ("q", "chr1", 10, 20, [0.0, 1.0]), ("q", "chr2", 0, 10, [0.6, 0.8])]
    refs = [("a", "chr1", 0, 10, [1.0, 0.0], "A"), ("b", "chr1", 0, 10, [0.0, 1.0], "B"),
            ("a", "chr1", 10, 20, [1.0, 1.0], "A")]
    q = spark.createDataFrame(rows, "sample_id string, chr string, start_bp long, end_bp long, fingerprint array<float>")
    r = spark.createDataFrame(refs, "sample_id string, chr string, start_bp long, end_bp long, "
                                    "fingerprint array<float>, cell_type string").withColumn("tissue", F.lit("t"))
    return q, r


def test_windows_without_reference(spark):
    """The plain variant keeps them at 0, the held-out variant asks the centroids."""
    from foldmark.operators.tables import locus_centroids
    q, r = windows(spark)
    w = S.window_results(q, S.locus_matches(q, r, 5))
    lost = w.where("chr = 'chr2'").first()
    assert (lost["similarity"], lost["top_cell_type"], lost["has_match"]) == (0.0, "unknown", False)
    assert R.best_group(S.locus_matches(q, r, 5), S.WINDOW_KEY).count() == 2
    levels = {x["chr"]: x["mean_similarity"] for x in rollups.chromosome_summary(w).collect()}
    assert levels["chr2"] == 0.0 and levels["chr1"] == pytest.approx((1 + 2 ** -0.5) / 2)
    h = S.heldout_windows(q, r, locus_centroids(r, 2)).where("chr = 'chr2'").first()
    assert (h["top_sample"], h["status"]) == ("NO_REFERENCE_LOCUS", "NO_REFERENCE")
    assert h["similarity"] == pytest.approx(1.4 / 2 ** 0.5, abs=1e-6)
    assert rollups.status_summary(S.heldout_windows(q, r, locus_centroids(r, 2))).first()["n_windows"] == 2


def test_permutation_p_value(spark):
    rng = np.random.default_rng(3)
    refs, qs = rng.normal(size=(5, 8)).astype(np.float32), rng.normal(size=(3, 8)).astype(np.float32)
    q = spark.createDataFrame([(f"q{i}", "chr1", 0, [float(x) for x in v]) for i, v in enumerate(qs)],
                              "sample_id string, chr string, start_bp long, fingerprint array<float>")
    r = spark.createDataFrame([("chr1", 0, [float(x) for x in v]) for v in refs],
                              "chr string, start_bp long, fingerprint array<float>")
    got = {x["sample_id"]: x for x in S.permutation_pvalues(q, r, 100, 42, 8).collect()}
    z = refs / (np.linalg.norm(refs, axis=1, keepdims=True) + 1e-8)
    for i, v in enumerate(qs.astype(np.float64)):
        obs = (z @ (v / (np.linalg.norm(v) + 1e-8))).mean()
        orders = [sorted(range(8), key=lambda p: hashlib.md5(f"42:{k}:{p}".encode()).hexdigest()) for k in range(100)]
        hits = sum((z @ (v[o] / (np.linalg.norm(v) + 1e-8))).mean() >= obs for o in orders)
        assert got[f"q{i}"]["observed"] == pytest.approx(obs, abs=1e-7)
        assert got[f"q{i}"]["p_value"] == pytest.approx((hits + 1) / 101)


def test_single_replicate_confidence_differs(spark):
    m = spark.createDataFrame([("q", "A_rep1", 0.5), ("q", "A_rep2", 0.54), ("q", "B", 0.4)],
                              "qid string, match_sample string, score double")
    got = {r["match_sample"]: r["confidence"] for r in R.group_matches(m, ["qid"]).collect()}
    assert got == {"A_rep1": "high", "A_rep2": "high", "B": "single_sample"}
    alone = R.best_group(m.where("match_sample = 'B'"), ["qid"]).first()
    assert (alone["grp"], alone["confidence"]) == ("B", "high")


def test_replicate_consistency_small_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(5, 4, 3)).astype(np.float32)
    rows = [(f"A_rep{s + 1}", f"chr{1 + w % 2}", w, [float(x) for x in v[s, w]]) for s in range(5) for w in range(4)]
    df = spark.createDataFrame(rows + [("B", "chr1", 0, [1.0, 0.0, 0.0])],
                               "sample_id string, chr string, start_bp long, fingerprint array<float>")
    got = {r["grp"]: r for r in R.replicate_consistency(df, rows=3).collect()}
    z = v / (np.linalg.norm(v, axis=2, keepdims=True) + 1e-8)
    sims = [(z[i] * z[j]).sum(axis=1).mean() for i in range(5) for j in range(i + 1, 5)]
    assert got["A"]["mean_cosine_similarity"] == pytest.approx(np.mean(sims), abs=1e-4)
    assert got["A"]["std_cosine_similarity"] == pytest.approx(np.std(sims), abs=1e-4)
    assert got["B"]["confidence"] == "single_sample" and got["A"]["n_replicates"] == 5


def test_row_order_does_not_matter(spark):
    df = frame(spark)
    a = E.neighbours(df, 3, block_rows=40).orderBy("id", "rank").collect()
    b = E.neighbours(df.orderBy(F.rand(5)).repartition(7), 3, block_rows=40).orderBy("id", "rank").collect()
    assert a == b


def test_histogram_scores_on_edges_and_labels_of_any_kind(spark, monkeypatch):
    """Scores on bin edges, copies and null labels; many tiles."""
    monkeypatch.setattr(blocks, "_TILE", (7, 11))
    rng = np.random.default_rng(5)
    x = rng.integers(-1, 2, size=(90, 4)).astype(float)
    label = [None if k % 9 == 0 else f"L{k % 4}" for k in range(90)]
    edges = np.array([-0.75, -0.5, -0.25, 0.0, 0.1, 0.5, 1.0])
    df = spark.createDataFrame([(k, label[k], x[k].tolist()) for k in range(90)], "id long, label string, fingerprint array<double>")
    got = {(r["kind"], r["bin"]): r["n"] for r in blocks.similarity_histogram(df, "label", edges, rows=40, eps=1e-300).collect()}
    s = np.round(unit(x, 1e-300) @ unit(x, 1e-300).T, 12)
    same = np.array([[a == b for b in label] for a in label])
    off = ~np.eye(90, dtype=bool)
    for kind, mask in (("intra", same & off), ("inter", ~same & off)):
        assert [got[kind, k] for k in range(1, 7)] == np.histogram(s[mask], edges)[0].tolist()


def test_few_scores_are_sorted_for_the_histogram():
    """Only scores next to an edge are compared with the edges; the others were sorted one by one."""
    edges = np.linspace(-0.2, 1.0, 80)
    cell_of, bin_of, unsure = blocks._fine_cells(edges)
    s = np.random.default_rng(1).uniform(-1, 1, 100_000)
    sure = ~unsure[cell_of(s)]
    assert sure.mean() > 0.99
    inside = sure & (s >= edges[0]) & (s <= edges[-1])
    assert (bin_of[cell_of(s)][inside] == np.searchsorted(edges, s[inside], "right") - 1).all()
    assert (bin_of[cell_of(s)][sure & ~inside] == -1).all()
