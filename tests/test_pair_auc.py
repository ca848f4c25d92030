"""AUC over all pairs of a group against plain numpy: blocks and ranges of every size, ties, gaps; no row per pair in the plan."""

import numpy as np
import pytest

from foldmark.operators import evaluation as E
from foldmark.operators.pair_auc import group_auc

SCHEMA = "place string, id long, label string, fingerprint array<double>"


def corpus():
    rng = np.random.default_rng(3)
    rows = [("hot" if k % 3 else f"p{k % 7}", k, f"L{k % 4}", [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(240)]
    return rows + [("lone", 900, "L1", [1.0, 0.0, 0.0, 0.0])]


def plain(rows, digits, eps=1e-8):
    same, score = [], []
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1]:
                x, y = np.array(a[3]), np.array(b[3])
                same.append(a[2] == b[2])
                score.append(round(float(x @ y) / ((np.linalg.norm(x) + eps) * (np.linalg.norm(y) + eps)), digits))
    same, score = np.array(same), np.array(score)
    p, q = score[same][:, None], score[~same][None, :]
    return ((p > q).sum() + 0.5 * (p == q).sum()) / (p.size * q.size)


@pytest.mark.parametrize("limits", [{}, {"block_rows": 16, "range_pairs": 700}])
@pytest.mark.parametrize("digits", [1, 12])
def test_group_auc(spark, digits, limits):
    gaps = [("hot", 950, "L1", None), ("hot", 951, "L1", [float("nan")] * 4), ("hot", 952, None, [1.0] * 4),
            (None, 953, "L1", [1.0] * 4), (None, 954, "L1", [1.0] * 4)]
    df = spark.createDataFrame(corpus() + gaps, SCHEMA).repartition(5)
    got = group_auc(df, ["place"], digits=digits, **limits).first()["auc"]
    assert got == pytest.approx(plain(corpus(), digits), abs=1e-12)


def test_auc_without_pairs_of_one_kind(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    assert group_auc(df.where("label = 'L1'"), ["place"]).first()["auc"] is None
    assert [r["auc"] for r in group_auc(df.limit(0), ["place"], (0, 2), axes=np.eye(4), mean=np.zeros(4)).collect()] == [None, None]


def test_auc_by_dimension_weighs_rows_by_partners(spark):
    rows = corpus()
    x, y = zip(*[(a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]], strict=True)
    both = np.concatenate([x, y])
    vals, vecs = np.linalg.eigh(np.cov(both.T))
    onto = lambda v, d: (np.array(v) - both.mean(axis=0)) @ vecs[:, ::-1][:, :d]
    got = {r["dims"]: r["auc"] for r in E.auc_by_dimension(spark.createDataFrame(rows, SCHEMA), ["place"], (2, 4, 9)).collect()}
    want = plain([(p, i, l, onto(v, 2)) for p, i, l, v in rows], 12)
    assert got[2] == pytest.approx(want, abs=1e-9) and got[4] == got[9] == pytest.approx(plain(rows, 12), abs=1e-9)


def test_no_pair_is_a_row(spark):
    """A join of the pairs would put n * (n - 1) / 2 rows through an exchange."""
    df = spark.createDataFrame(corpus(), SCHEMA)
    from foldmark.operators import pair_auc as P
    seen = {}
    real, P.written = P.written, lambda d, name: seen.setdefault("runs", d)
    try:
        group_auc(df, ["place"])
    finally:
        P.written = real
    plan = seen["runs"]._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


def test_scores_are_shuffled_in_passes(spark, monkeypatch):
    """All runs at once took disk for every pair; a pass writes the counts of its own ranges and leaves the setting as it was."""
    from foldmark.operators import pair_auc as P
    df = spark.createDataFrame(corpus(), SCHEMA)
    made, real, setting = [], P.written, spark.conf.get(P._CLEANUP)

    def kept(d, name):
        assert spark.conf.get(P._CLEANUP) == "true"
        made.append(real(d, name))
        return made[-1]

    monkeypatch.setattr(P, "written", kept)
    got = group_auc(df, ["place"], (0, 2), axes=np.eye(4), mean=np.zeros(4), block_rows=16, range_pairs=1000, pass_pairs=4000)
    auc = {r["dims"]: r["auc"] for r in got.collect()}
    assert auc[0] == pytest.approx(plain(corpus(), 12), abs=1e-12)
    assert auc[2] == pytest.approx(plain([(p, i, l, v[:2]) for p, i, l, v in corpus()], 12), abs=1e-12)
    ranges = [{(r["dims"], r["range"]) for r in m.collect()} for m in made]
    assert len(made) > 2 and max(map(len, ranges)) <= 4 and sum(map(len, ranges)) == len(set().union(*ranges))
    assert spark.conf.get(P._CLEANUP) == setting


def test_two_blocks_meet_once(spark):
    """Both orders of two blocks doubled the products and the rows shuffled."""
    from foldmark.operators import blocks
    df = spark.createDataFrame(corpus(), SCHEMA).select("place", "id")
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType
    schema = StructType([StructField("q", LongType()), StructField("r", LongType())])
    kernel = lambda q, r: pa.table({"q": [min(q["id"].to_pylist())], "r": [min(r["id"].to_pylist())]})
    met = [tuple(r) for r in blocks.block_pairs(df, df, kernel, schema, keys=["place"], rows=16, once=True).collect()]
    n = len({q for q, _ in met if (q, q) in met})
    assert len(met) == len({frozenset(m) for m in met}) and n > 5
