"""Codes, tables, splits, readers, sinks and streams."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmark.operators import codes as K
from foldmark.operators import tables as T
from foldmark.plans import build
from foldmark.sources import files, store
from foldmark.streaming import ingest


def test_split_sizes_and_single_rows(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") == 0, "one").when(F.col("id") < 700, "hot").otherwise("c").alias("s"))
    out = T.stratified_split(df, "s", "id", 0.1)
    n = {(r["s"], r["split"]): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert n == {("one", "val"): 1, ("hot", "val"): 69, ("hot", "train"): 630, ("c", "val"): 30, ("c", "train"): 273}
    again = T.stratified_split(df.repartition(5), "s", "id", 0.1)
    assert sorted(map(tuple, out.select("id", "split").collect())) == sorted(map(tuple, again.select("id", "split").collect()))


def test_global_split_of_few_rows(spark):
    got = T.global_split(spark.range(3), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 2, "val": 1}
    got = T.global_split(spark.range(25), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 23, "val": 2}


def test_code_ties_and_ema(spark):
    rng = np.random.default_rng(2)
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [9.0, 9.0])], "code int, vec array<float>")
    x = np.vstack([[1.0, 0.0], rng.normal(size=(20, 2))]).astype(np.float32)
    tok = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, token array<float>")
    a = K.assign_codes(tok, book, ["id"])
    assert a.where("id = 0").first()["code"] == 0  # equally far: the lower code
    code = {r["id"]: r["code"] for r in a.collect()}
    slow = {r["id"]: r["code"] for r in K.assign_codes(tok, book, ["id"], max_sent=1).collect()}
    assert code == slow
    state = book.select("code", F.lit(1.0).alias("ema_count"), F.col("vec").alias("ema_sum"))
    got = {r["code"]: r for r in K.ema_update(state, a, 2).collect()}
    v0 = np.array([[0, 0], [2, 0], [9, 9]], float)
    cnt = np.array([sum(c == k for c in code.values()) for k in range(3)], float)
    tot = np.array([sum((x[i].astype(float) for i in code if code[i] == k), np.zeros(2)) for k in range(3)])
    c, s = 0.995 + 0.005 * cnt, 0.995 * v0 + 0.005 * tot
    smooth = (c + 1e-5) / (c.sum() + 3e-5) * c.sum()
    for k in range(3):
        assert np.allclose(got[k]["vec"], s[k] / smooth[k])


def test_revival_repeats_tokens(spark):
    book = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "code int, vec array<float>")
    usage = spark.createDataFrame([(i, 5 if i == 0 else 0) for i in range(6)], "code int, n long")
    tok = spark.createDataFrame([(0, [50.0, 50.0]), (1, [70.0, 70.0])], "id long, token array<float>")
    got = {r["code"]: r for r in K.revive_dead_codes(book, usage, tok, key=["id"]).collect()}
    assert got[0]["vec"] == [0.0, 0.0] and not got[0]["revived"]
    for k in range(1, 6):
        near = min(abs(got[k]["vec"][0] - 50), abs(got[k]["vec"][0] - 70))
        assert got[k]["revived"] and 0 < near < 0.1


def test_listing_and_registry(spark, tmp_path):
    for n in ("K562_4DNFI1.mcool", "K562_ENCFF2.mcool", "IMR-90_rep1.mcool", "x.txt"):
        (tmp_path / n).write_bytes(b"123")
    f = files.listing(spark, str(tmp_path), "*.mcool")
    got = {r["sample_id"]: r["file"] for r in files.sample_registry(f).collect()}
    assert got == {"K562": "K562_ENCFF2.mcool", "IMR-90_rep1": "IMR-90_rep1.mcool"}
    groups = {r["cell"]: len(r["paths"]) for r in files.group_files(f).collect()}
    assert groups == {"K562": 2, "IMR-90": 1}
    assert files.registry_or_fallback(f.where("false")).count() == 5
    assert files.registry_or_fallback(f).count() == 2


def test_text_readers(spark, tmp_path):
    bed = tmp_path / "a.bed.gz"
    lines = ["# head", "", "chr1\t1\t5\t.\t.\t.\t.\t.\t.\tPLS ", "chr1\t7\t9\tshort", "chrUn\t1\t2\t.\t.\t.\t.\t.\t.\tdELS",
             "chr2\t1\t2\t.\t.\t.\t.\t.\t.\tweird\textra"]
    with gzip.open(bed, "wt") as h:
        h.write("\n".join(lines) + "\n")
    got = sorted((r["chrom"], r["start_bp"], r["category"]) for r in files.read_ccre(spark, str(bed)).collect())
    assert got == [("chr1", 1, "PLS"), ("chr2", 1, "Low-DNase"), ("chrUn", 1, "dELS")]
    assert files.read_ccre(spark, str(bed), chromosomes_only=True).count() == 2

    gtf = tmp_path / "g.gtf"
    a = 'gene_id "G1"; gene_type "protein_coding"; gene_name "MYC";'
    gtf.write_text("\n".join(["##x", f"chr8\tH\tgene\t100\t200\t.\t+\t.\t{a}", f"chr8\tH\texon\t100\t200\t.\t+\t.\t{a}",
                              f"chr9\tH\tgene\t5\t6\t.\t+\t.\t{a}", 'chr1\tH\tgene\t11\t20\t.\t-\t.\tgene_id "G2";']) + "\n")
    got = {r["gene_id"]: r for r in files.read_genes(spark, str(gtf)).collect()}
    assert (got["G1"]["chrom"], got["G1"]["start_bp"], got["G1"]["cancer_role"]) == ("chr8", 99, "oncogene")
    assert (got["G2"]["gene_name"], got["G2"]["gene_type"]) == ("G2", "unknown")

    band = tmp_path / "c.txt"
    band.write_text("chr1\t0\t5\tp1\tacen\n")
    assert files.read_cytoband(spark, str(band)).first()["giestain"] == "acen"
    assert files.fallback_genes(spark).count() == 32
    assert files.fallback_genes(spark).where("gene_name = 'RUNX1'").first()["cancer_role"] == "oncogene"
    assert files.curated_genes(spark).count() == len(set(
        r["gene_name"] for r in files.curated_genes(spark).collect()))


DIM = 4


def tiles(spark, samples, n=3):
    rng = np.random.default_rng(0)
    rows = [(s, s.split("_")[0], 0, "chr1", i * 4, i * 4 + 8, i * 400, i * 400 + 800, [float(x) for x in rng.normal(size=64)])
            for s in samples for i in range(n)]
    from foldmark import schema
    return spark.createDataFrame(rows, schema.TILES)


def test_store_round(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "db"))
    reg = spark.createDataFrame([("A_rep1", "a", "bulk_hic", "x"), ("B", "b", "bulk_hic", None)], "sample_id string, file string, assay string, tissue string")
    st.register_samples(reg)
    st.register_samples(reg)
    assert st.read("samples").count() == 2
    enc = build.mean_projection(DIM)
    fps = build.encode_tiles(tiles(spark, ["A_rep1", "B"]), enc, dim=DIM).select("sample_id", "chr", "start_bp", "end_bp", "fingerprint")
    st.ingest(fps)
    st.ingest(fps)
    got = st.read("window_fingerprints")
    assert sorted(r["id"] for r in got.select("id").collect()) == list(range(1, 7))
    st.replace("locus_centroids", T.locus_centroids(got, DIM))
    assert {r["n_samples"] for r in st.read("locus_centroids").collect()} == {2}
    st.replace("samples", T.refresh_tile_counts(st.read("samples"), got))
    assert {r["n_tiles"] for r in st.read("samples").collect()} == {3}
    st.upsert_histograms(spark.createDataFrame([("B", [0.5, 0.5])], "sample_id string, code_histogram array<float>"))
    st.upsert_histograms(spark.createDataFrame([("B", [1.0, 0.0])], "sample_id string, code_histogram array<float>"))
    assert [r["code_histogram"] for r in st.read("sample_histograms").collect()] == [[1.0, 0.0]]
    st.overwrite_samples(spark.createDataFrame([("B",)], "sample_id string"))
    assert {r["sample_id"] for r in st.read("window_fingerprints").collect()} == {"A_rep1"}
    assert st.read("locus_centroids").count() == 0
    st.views()
    assert spark.sql("SELECT count(*) AS n FROM window_fingerprints WHERE chr = 'chr1'").first()["n"] == 3


def test_build_store_and_combine(spark):
    t = tiles(spark, ["A_rep1", "A_rep2", "B"], 12)
    samples = spark.createDataFrame([("A_rep1", 0), ("A_rep2", 0), ("B", 0), ("C", 0)], "sample_id string, n_tiles int")
    from foldmark import schema
    old = spark.createDataFrame([], schema.FINGERPRINTS)
    out = build.build_store(t, build.mean_projection(DIM), samples, old, dim=DIM)
    assert sorted(r["id"] for r in out["window_fingerprints"].collect()) == list(range(1, 37))
    assert {r["sample_id"]: r["n_tiles"] for r in out["samples"].collect()} == {"A_rep1": 12, "A_rep2": 12, "B": 12, "C": 0}
    vec = out["centroid_index"].first()["vector"]
    assert np.linalg.norm(vec) == pytest.approx(1, abs=1e-6)
    c = build.combine(t)
    n = {(r["sample_id"], r["split"]): r["count"] for r in c.groupBy("sample_id", "split").count().collect()}
    assert n == {(s, p): k for s in ("A_rep1", "A_rep2", "B") for p, k in (("val", 1), ("train", 11))}
    named = build.label_tiles(t.drop("cell_line_name", "cell_line_idx")).select("cell_line_name", "cell_line_idx").distinct()
    assert {tuple(r) for r in named.collect()} == {("A", 0), ("B", 1)}


def test_tile_files_and_sinks(spark, tmp_path):
    t = tiles(spark, ["A_rep1", "B"])
    store.write_tiles(t, str(tmp_path / "t"))
    back = store.read_tiles(spark, str(tmp_path / "t"))
    assert back.count() == 6 and "matrix" in back.columns
    plan = back.where("sample_id = 'B'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(sample_id" in plan
    store.write_label_map(T.label_map(t, "cell_line_name"), str(tmp_path / "m"))
    assert store.read_label_map(spark, str(tmp_path / "m")).count() == 2
    assert store.read_label_map(spark, str(tmp_path / "none"), t).count() == 2
    log = spark.createDataFrame([("A", "ok", 1.25, 3, 0.04)], "sample_id string, status string, file_mb double, tiles int, elapsed_s double")
    store.write_timing(log, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    store.write_report(log, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1


def test_tile_stream_is_idempotent(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "db"))
    src = str(tmp_path / "tiles")
    enc = build.mean_projection(64)
    for samples, want in ((["A"], 3), (["B", "C"], 9)):
        store.write_tiles(tiles(spark, samples), src)
        ingest.ingest_stream(ingest.tile_stream(spark, src), st, enc, str(tmp_path / "cp")).awaitTermination()
        assert st.read("window_fingerprints").count() == want
    # the same files again, as after a lost checkpoint: nothing new
    ingest.ingest_stream(ingest.tile_stream(spark, src), st, enc, str(tmp_path / "cp2")).awaitTermination()
    f = st.read("window_fingerprints")
    assert f.count() == 9 and f.select("id").distinct().count() == 9
    asked = spark.createDataFrame([("A", "chr1"), ("A", "chr2")], "sample_id string, chrom string")
    assert [r["chrom"] for r in ingest.pending(asked, st).collect()] == ["chr2"]


def test_code_stream_equals_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    book = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=2)]) for i in range(3)], "code int, vec array<float>")
    state = ingest.CodeState(spark, str(tmp_path / "s"))
    state.start(book)
    src = str(tmp_path / "tok")
    parts = []
    for b in range(2):
        rows = [(b * 10 + i, [float(x) for x in rng.normal(size=2)]) for i in range(10)]
        df = spark.createDataFrame(rows, "id long, token array<float>")
        parts.append(df)
        df.coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("id long, token array<float>").parquet(src)
        ingest.code_stream(s, state, ["id"], 2, str(tmp_path / "c")).awaitTermination()
    want = state.version(0)
    for df in parts:
        want = K.ema_update(want, K.assign_codes(df, want.select("code", "vec"), ["id"]), 2)
    got = {r["code"]: r["vec"] for r in state.version(2).collect()}
    for r in want.collect():
        assert np.allclose(got[r["code"]], r["vec"])


def test_both_ways_of_coding_agree(spark):
    book = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "code int, vec array<float>")
    tok = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [0.0, 1.0]), (2, None)],
                                "id long, token array<float>")
    for most in (16, 1):
        got = K.assign_codes(tok, book, ["id"], max_sent=most).collect()
        assert sorted((str(r["id"]), str(r["token"]), r["code"], r["sq_dist"]) for r in got) == [
            ("1", "[0.0, 1.0]", 1, 0.0), ("1", "[1.0, 0.0]", 0, 0.0), ("2", "None", None, None), ("None", "[0.0, 1.0]", 1, 0.0)]


def test_unfinished_version_is_not_read(spark, tmp_path):
    import os
    import shutil
    st = store.Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("A", [1.0])], "sample_id string, code_histogram array<float>")
    st.upsert_histograms(rows)
    full = str(tmp_path / "s" / "sample_histograms")
    assert st.versions("sample_histograms") == [1]
    shutil.copytree(f"{full}/v1", f"{full}/v2")
    os.remove(f"{full}/v2/_SUCCESS")  # a write that broke off
    assert st.versions("sample_histograms") == [1] and st.read("sample_histograms").count() == 1
    st.upsert_histograms(rows.withColumn("sample_id", F.lit("B")))
    assert st.versions("sample_histograms") == [2] and st.read("sample_histograms").count() == 2


def test_upsert_takes_the_latest_of_several(spark):
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "k int, t int, x string")
    new = spark.createDataFrame([(2, 5, "late"), (2, 3, "early"), (3, 1, "c")], "k int, t int, x string")
    assert sorted(map(tuple, T.upsert(old, new, "k", "t").collect())) == [(1, 0, "a"), (2, 5, "late"), (3, 1, "c")]


def test_preprocess_skips_what_is_done(spark, tmp_path):
    from test_genome import N_BINS, SIZE, STEP, contact_case, spark_case
    m, w = contact_case(1)
    pixels, bins, bands, chroms = spark_case(spark, m, w)
    path = str(tmp_path / "t")
    build.preprocess(pixels, bins, bands, chroms, path, size=SIZE, step=STEP)
    n = store.read_tiles(spark, path).count()
    other = lambda df: df.unionByName(df.withColumn("sample_id", F.lit("S_rep2")))
    build.preprocess(other(pixels), other(bins), bands, chroms, path, size=SIZE, step=STEP)
    got = {r["sample_id"]: r["count"] for r in store.read_tiles(spark, path).groupBy("sample_id").count().collect()}
    assert got == {"S": n, "S_rep2": n} and N_BINS == 40
    more = lambda df: df.withColumn("sample_id", F.lit("A"))
    build.preprocess(other(pixels).unionByName(more(pixels)), other(bins).unionByName(more(bins)), bands, chroms, path,
                     size=SIZE, step=STEP)
    labels = {tuple(r) for r in store.read_tiles(spark, path).select("cell_line_name", "cell_line_idx").distinct().collect()}
    assert labels == {("S", 0), ("A", 1)}


def test_hash_sample_and_numbering(spark):
    df = spark.range(5000).withColumn("s", F.concat(F.lit("s"), F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 7))
                                      ).withColumn("c", F.col("id") % 3)
    a = T.first_in_hash_order(df, 37, ["id"])
    b = T.first_in_hash_order(df.repartition(9), 37, ["id"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(r["_k"] for r in a.collect()) == list(range(37))
    got = [(r["s"], r["c"], r["id"]) for r in T.dense_numbering(df, ["s", "c", "id"]).orderBy("_row").collect()]
    assert got == sorted(got) and len(got) == 5000
    assert T.dense_numbering(df, ["s", "c", "id"]).agg(F.min("_row"), F.max("_row"), F.count_distinct("_row")).first()[:] == (1, 5000, 5000)


def test_transposed_half(spark):
    from foldmark.operators import contacts
    df = spark.range(200).withColumn("matrix", F.array(*[F.lit(float(i)) for i in range(4)]))
    got = contacts.transpose_some(df, ["id"], 2).collect()
    flipped = [r for r in got if r["transposed"]]
    assert 60 < len(flipped) < 140
    assert all(r["matrix"] == ([0.0, 2.0, 1.0, 3.0] if r["transposed"] else [0.0, 1.0, 2.0, 3.0]) for r in got)
