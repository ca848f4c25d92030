"""Interval joins, annotation and contact maps on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmark import constants as C
from foldmark.operators import annotation as A
from foldmark.operators import contacts as K
from foldmark.operators import intervals as I
from foldmark.plans import build

RNG = np.random.default_rng(11)


def test_overlap_edges(spark):
    w = spark.createDataFrame([("chr1", 100, 200)], "chrom string, win_start long, win_end long")
    iv = spark.createDataFrame([("chr1", a, b) for a, b in [(50, 100), (200, 250), (99, 101), (199, 300), (0, 500), (120, 130)]],
                               "chrom string, start_bp long, end_bp long")
    got = {(r["start_bp"], r["end_bp"]) for r in I.overlap_join(w, iv, ["chrom"], bucket=64).collect()}
    assert got == {(99, 101), (199, 300), (0, 500), (120, 130)}


@pytest.mark.parametrize("bucket,salt", [(7, 1), (64, 3), (10_000, 8)])
def test_overlap_equals_plain_predicate(spark, bucket, salt):
    s = RNG.integers(0, 1000, 200)
    e = s + RNG.integers(1, 120, 200)
    ws = RNG.integers(-50, 1000, 20)
    we = ws + RNG.integers(1, 300, 20)
    iv = spark.createDataFrame([("a" if i % 3 else "b", int(x), int(y), i) for i, (x, y) in enumerate(zip(s, e))],
                               "chrom string, start_bp long, end_bp long, i int")
    w = spark.createDataFrame([("a", int(x), int(y), i) for i, (x, y) in enumerate(zip(ws, we))],
                              "chrom string, win_start long, win_end long, w int")
    got = sorted((r["w"], r["i"]) for r in I.overlap_join(w, iv, ["chrom"], bucket=bucket, salt=salt).collect())
    want = sorted((a, b) for a in range(20) for b in range(200) if b % 3 and s[b] < we[a] and e[b] > ws[a])
    assert got == want


def test_grid_counts_with_mixed_windows(spark):
    s = RNG.integers(0, 1000, 300)
    e = s + RNG.integers(0, 150, 300)  # some of length zero, some spanning several cells
    iv = spark.createDataFrame([("x", int(a), int(b), "PLS" if i % 2 else "dELS") for i, (a, b) in enumerate(zip(s, e))],
                               "chrom string, start_bp long, end_bp long, category string")
    wins = [(0, 200), (100, 300), (150, 400), (33, 77), (900, 1300)]
    w = spark.createDataFrame([("x", a, b) for a, b in wins], "chrom string, win_start long, win_end long")
    got = {(r["win_start"], r["category"]): r["n"] for r in I.overlap_counts(w, iv, ["chrom"], "category", grid=100, bucket=90).collect()}
    for a, b in wins:
        for k, c in enumerate(("dELS", "PLS")):
            assert got.get((a, c), 0) == int(((s < b) & (e > a) & (np.arange(300) % 2 == k)).sum())


def test_annotation_vector_guards(spark):
    w = spark.createDataFrame([("s", "chr1", 0, 1_000_000), ("none", "chr1", 0, 1_000_000), ("s", "chr9", 0, 1_000_000)],
                              "sample_id string, chrom string, win_start long, win_end long")
    iv = spark.createDataFrame([("s", "chr1", 10, 20, "PLS"), ("s", "chr1", 30, 40, "CA-CTCF"), ("s", "chr1", 50, 60, "odd")],
                               "sample_id string, chrom string, start_bp long, end_bp long, category string")
    iv = iv.withColumn("category", A.clean_category(F.col("category")))
    got = {r["chrom"]: r for r in A.annotate_windows(w, iv, grid=1_000_000).collect()}
    assert set(got) == {"chr1", "chr9"}  # a sample without elements has no annotation
    one, zero = got["chr1"], got["chr9"]
    assert (one["n_active"], one["Low-DNase"], one["regulatory_complexity"], one["promoter_ratio"],
            one["total_density"]) == (2.0, 1.0, 1.0, 0.5, 3.0)
    assert zero["n_active"] == 0.0 and zero["promoter_ratio"] == 0.0 and zero["regulatory_complexity"] == 0.0


def genes(spark, rows):
    g = spark.createDataFrame(rows, "gene_id string, chrom string, start_bp long, end_bp long, gene_name string")
    return A.with_roles(g.withColumn("gene_type", F.lit("protein_coding")))


def test_nearest_equals_scan(spark):
    s = RNG.integers(0, 5_000_000, 60)
    e = s + RNG.integers(100, 400_000, 60)
    rows = [(f"g{i:02d}", "chr1", int(a), int(b), f"N{i}") for i, (a, b) in enumerate(zip(s, e))]
    pos = [int(p) for p in RNG.integers(0, 6_500_000, 300)] + [int(s[0]), int(e[0]), int(e[1]) + 500_000]
    p = spark.createDataFrame([("chr1", x) for x in pos] + [("chr7", 5)], "chrom string, pos long")
    got = {(r["chrom"], r["pos"]): (r["gene_id"], r["distance_bp"])
           for r in A.nearest_genes(p, genes(spark, rows), 500_000).collect()}

    def scan(x):
        best = None
        for gid, _, a, b, _ in rows:
            d = a - x if x < a else b - x if x > b else 0
            if abs(d) <= 500_000 and a < x + 1 + 500_000 and b > max(0, x - 500_000):
                best = min(best, (abs(d), a, gid, d)) if best else (abs(d), a, gid, d)
        return (best[2], best[3]) if best else (None, None)

    assert got[("chr7", 5)] == (None, None)
    for x in set(pos):
        assert got[("chr1", x)] == scan(x)


def test_nearest_among_nested_and_equal_genes(spark):
    rows = [("a", "chr1", 100, 900, "A"), ("b", "chr1", 100, 900, "B"), ("c", "chr1", 50, 60, "C"), ("d", "chr1", 200, 300, "D"),
            ("e", "chr1", 1100, 1200, "E"), ("f", "chr1", 20, 900, "F"), ("g", "chr1", 1100, 1150, "G"), ("h", None, 5, 9, "H"),
            ("i", "chr1", None, 9, "I")]
    p = spark.createDataFrame([("chr1", x) for x in (10, 55, 250, 950, 1000, 1001, 1300, 1700, 1701, None)] + [(None, 4)], "chrom string, pos long")
    got = {(r["chrom"], r["pos"]): (r["gene_id"], r["distance_bp"]) for r in A.nearest_genes(p, genes(spark, rows), 500, width=128).collect()}
    want = {10: ("f", 10), 55: ("f", 0), 250: ("f", 0), 950: ("f", -50), 1000: ("f", -100), 1001: ("e", 99), 1300: ("e", -100),
            1700: (None, None), 1701: (None, None), None: (None, None)}
    assert got == {("chr1", k): v for k, v in want.items()} | {(None, 4): (None, None)}


def test_work_of_a_position_does_not_grow_with_the_genes_of_its_cell(spark):
    p = spark.createDataFrame([("chr1", 5)], "chrom string, pos long")
    plan = A.nearest_genes(p, genes(spark, [("a", "chr1", 1, 9, "A")]))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_element_order_treats_zero_distance_as_missing(spark):
    g = genes(spark, [("a", "chr1", 100, 200, "MYC"), ("b", "chr1", 5000, 5100, "TP53"), ("c", "chr1", 90_000, 90_100, "X")])
    c = spark.createDataFrame([("s", "chr1", 0, 99_999_999, "PLS", x, x + 2) for x in (150, 4000, 91_000)] +
                              [("s", "chr1", 0, 99_999_999, "PLS", 9_000_000, 9_000_002)],
                              "sample_id string, chrom string, win_start long, win_end long, category string, start_bp long, end_bp long")
    got = {r["start_bp"]: (r["rank"], r["nearest_gene"], r["distance_label"]) for r in A.annotate_elements(c, g).collect()}
    assert got[4000][0] == 1 and got[150] == (2, "MYC", "overlapping")  # both cancer genes, distance 0 last
    assert got[91_000][:2] == (3, "X") and got[9_000_000] == (4, "intergenic", "intergenic")


def test_gene_over_the_midpoint(spark):
    w = spark.createDataFrame([("chr1", 1000, 2000)], "chrom string, win_start long, win_end long")
    g = genes(spark, [("a", "chr1", 1400, 1600, "A"), ("b", "chr1", 1900, 1950, "B"), ("c", "chr1", 100, 500, "C")])
    got = {r["gene_id"]: (r["distance_bp"], r["in_window"], r["rank"]) for r in A.genes_near(w, g, 1100).collect()}
    assert got == {"a": (0, True, 1), "b": (400, True, 2), "c": (-1000, False, 3)}


def test_annotation_file_rules(spark):
    files = spark.createDataFrame([("/a/K562.bed.gz",), ("/a/IMR-90_x.bed.gz",), ("/a/HeLa_ENCFF1.bed.gz",)], "path string")
    s = spark.createDataFrame([("K562",), ("IMR-90",), ("HeLa",), ("none",)], "sample_id string")
    got = {r["sample_id"]: r["path"] for r in A.discover_annotations(s, files).collect()}
    assert got == {"K562": "/a/K562.bed.gz", "IMR-90": "/a/IMR-90_x.bed.gz", "HeLa": "/a/HeLa_ENCFF1.bed.gz"}


# ---- contact maps: the dense computation in numpy ---------------------------

N_BINS, SIZE, STEP = 40, 12, 6


def contact_case(seed, empty_weights=False):
    rng = np.random.default_rng(seed)
    m = rng.poisson(0.7, size=(N_BINS, N_BINS)).astype(float)
    m = np.triu(m) + np.triu(m, 1).T
    w = 1.0 / (3 + np.arange(N_BINS) % 5)
    w[[4, 17, 30]] = np.nan
    if empty_weights:
        w[:] = np.nan
    return m, w


def dense_log_oe(m, w, ignore):
    b = m * w[:, None] * w[None, :]
    out = np.full(m.shape, np.nan)
    d = np.abs(np.subtract.outer(np.arange(N_BINS), np.arange(N_BINS)))
    for k in range(N_BINS):
        diag = np.diagonal(b, k)
        ok = ~np.isnan(diag)
        e = diag[ok].mean() if ok.any() and k >= ignore else np.nan
        out[d == k] = (b[d == k] / e) if e > 0 else 0.0
    log = np.log2(out + 1e-6)
    return np.clip(np.nan_to_num(log, nan=0.0), -5, 5)


def spark_case(spark, m, w):
    i, j = np.nonzero(np.triu(m))
    pixels = spark.createDataFrame([("S", "chr1", int(a), int(b), float(m[a, b])) for a, b in zip(i, j)],
                                   "sample_id string, chrom string, bin1 long, bin2 long, cnt double")
    bins = spark.createDataFrame([("S", "chr1", k, None if np.isnan(x) else float(x)) for k, x in enumerate(w)],
                                 "sample_id string, chrom string, bin long, weight double")
    bands = spark.createDataFrame([("chr1", 900_000, 1_150_000, "p", "acen"), ("chr1", 2_000_000, 2_100_000, "q", "gneg")],
                                  "chrom string, start_bp long, end_bp long, name string, giestain string")
    chroms = spark.createDataFrame([("chr1", N_BINS)], "chrom string, n_bins int")
    return pixels, bins, bands, chroms


@pytest.mark.parametrize("seed,ignore,empty", [(1, 2, False), (2, 0, False), (3, 2, True)])
def test_tiles_equal_dense(spark, seed, ignore, empty):
    m, w = contact_case(seed, empty)
    pixels, bins, bands, chroms = spark_case(spark, m, w)
    want = dense_log_oe(m, w, ignore)
    bad = sorted(set(range(9, 13 + 0)) | {0, 1, 2, 37, 38, 39})  # 900k..1150k: bins 9..11 and one beyond
    assert sorted(r["bin"] for r in K.bad_bins(bands, chroms).collect()) == bad
    want[bad, :] = 0
    want[:, bad] = 0
    got = build.build_tiles(pixels, bins, bands, chroms, size=SIZE, step=STEP, ignore_diags=ignore).collect()
    good = np.ones(N_BINS, bool)
    good[bad] = False
    starts = [s for s in range(0, N_BINS - SIZE + 1, STEP) if good[s:s + SIZE].mean() >= 0.2]
    assert sorted(r["start_bin"] for r in got) == starts
    for r in got:
        s = r["start_bin"]
        tile = np.array(r["matrix"]).reshape(SIZE, SIZE)
        assert np.allclose(tile, want[s:s + SIZE, s:s + SIZE], atol=1e-6)
        assert (r["start_bp"], r["end_bp"]) == (s * 100_000, (s + SIZE) * 100_000)


def test_query_tiles_are_not_masked(spark):
    m, w = contact_case(5)
    pixels, bins, _, _ = spark_case(spark, m, w)
    want = dense_log_oe(m, w, 2)
    got = build.build_query_tiles(pixels, bins, size=SIZE, step=STEP).collect()
    diag = np.abs(np.subtract.outer(np.arange(SIZE), np.arange(SIZE))) <= 20
    keep = [s for s in range(0, N_BINS - SIZE + 1, STEP) if (want[s:s + SIZE, s:s + SIZE][diag] > 0).mean() >= 0.05]
    assert sorted(r["start_bin"] for r in got) == keep
    for r in got:
        s = r["start_bin"]
        assert np.allclose(np.array(r["matrix"]).reshape(SIZE, SIZE), want[s:s + SIZE, s:s + SIZE], atol=1e-6)


def test_short_chromosome_has_no_tile(spark):
    m, w = contact_case(1)
    pixels, bins, bands, chroms = spark_case(spark, m, w)
    assert build.build_tiles(pixels, bins, bands, chroms, size=41, step=20).count() == 0


def test_denominators(spark):
    m, w = contact_case(4)
    pixels, bins, _, _ = spark_case(spark, m, w)
    b = m * w[:, None] * w[None, :]
    plain = {r["dist"]: r["expected"] for r in K.expected(pixels, bins).collect()}
    pos = {r["dist"]: r["expected"] for r in K.expected_positive(pixels, bins).collect()}
    for k in range(N_BINS):
        d = np.diagonal(b, k)
        if (~np.isnan(d)).any():
            assert plain[k] == pytest.approx(np.nanmean(d))
        else:
            assert plain[k] is None
        if (np.nan_to_num(d) > 0).any():
            assert pos[k] == pytest.approx(d[np.nan_to_num(d) > 0].mean())


def test_diagonal_pool_and_band(spark):
    t = RNG.normal(size=(8, 8))
    df = spark.createDataFrame([([float(x) for x in t.ravel()],)], "matrix array<float>")
    got = df.select(K.diagonal_pool(F.col("matrix"), 8, 2).alias("p")).first()["p"]
    pad = np.pad(t, ((0, 0), (2, 2)))
    assert np.allclose(got, [pad[i, i:i + 5].mean() for i in range(8)], atol=1e-6)
    assert K.band_cells(256, 20) == sum(256 - abs(k) for k in range(-20, 21))
    assert C.TILE_SIZE == 256
