"""Column functions on hand-computed cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmark.functions import genes as G
from foldmark.functions import labels as L
from foldmark.functions import names as N
from foldmark.functions import vectors as V


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


NAMES = [
    ("GM12878_4DNFI2A4OBS9", "GM12878"),
    ("HCT116_auxin2h_4DNFI3PNAYBK", "HCT116"),
    ("dTAG-NIPBL_hTERT-RPE-1_-_clone_A2_ENCFF123", "dTAG-NIPBL_hTERT-RPE-1"),
    ("foreskin_fibroblast_4DNFIQJQY7PW", "foreskin_fibroblast"),
    ("CyT49_differentiated_to_definitive_endoderm_4DNFINXSKZ4F", "CyT49_differentiated_to_definitive_endoderm"),
    ("HeLa-S3_ENCFF960YUI", "HeLa-S3"), ("K562_rep1", "K562"), ("IMR-90_r2", "IMR-90"),
    ("lahomax", "la"),  # the genotype tokens cut anywhere in a name
    ("rep1", "rep1"),  # nothing left: the stem stays
]


@pytest.mark.parametrize("stem,name", NAMES)
def test_cell_name(spark, stem, name):
    assert one(spark, N.cell_name(F.lit(stem))) == (name,)


@pytest.mark.parametrize("sid,group", [
    ("K562_rep1", "K562"), ("IMR-90_r2", "IMR-90"), ("HeLa-S3", "HeLa-S3"), ("K562_batch_A", "K562"),
    ("K562_batchA", "K562"), ("X.3", "X"), ("X_5", "X"), ("X_6", "X_6"), ("K562_REP1", "K562_REP1")])
def test_replicate_group(spark, sid, group):
    assert one(spark, N.replicate_group(F.lit(sid))) == (group,)


def test_chromosome_keys(spark):
    got = one(spark, N.chromosome_order(F.lit("chr12")), N.chromosome_order(F.lit("chrX")),
              N.chromosome_index(F.lit("chrX")), N.chromosome_index(F.lit("chrM")), N.assay_code(F.lit("sc_hic")),
              N.assay_code(F.lit("other")))
    assert got == (12, 999, 23, None, 2, 0)


def test_thresholds_at_the_bound(spark):
    at = lambda x: F.lit(x)
    assert one(spark, L.similarity_class(at(0.7)), L.similarity_class(at(0.3)),
               L.similarity_class_inclusive(at(0.7)), L.similarity_class_inclusive(at(0.3)),
               L.confidence_badge(at(0.9)), L.chromosome_status(at(0.3)), L.window_status(at(0.3)),
               L.pair_verdict(at(0.95)), L.spread_confidence(at(0.05)), L.is_divergent(at(0.3))) == (
        "PARTIALLY_SIMILAR", "STRUCTURALLY_DIFFERENT", "STRUCTURALLY_SIMILAR", "PARTIALLY_SIMILAR",
        "VERY HIGH ★★★", "DIVERGENT", "PARTIAL", "VERY SIMILAR", "medium", False)


def test_concordance_labels(spark):
    null = F.lit(None).cast("double")
    assert one(spark, L.boundary_concordance_label(F.lit(0.29)), L.boundary_concordance_label(F.lit(0.7)),
               L.compartment_concordance_label(F.lit(0.1)), L.compartment_concordance_label(F.lit(0.3)),
               L.boundary_concordance_label(null)) == ("low", "high", "very low", "low", None)


def test_texts(spark):
    got = one(spark, L.bar(F.lit(0.5), 4), L.bar(F.lit(0.125), 4), L.change_arrow(F.lit(3)), L.change_arrow(F.lit(-2)),
              L.change_arrow(F.lit(0)), L.locus_mb(F.lit("chr1"), F.lit(140_900_000), F.lit(166_000_000)),
              L.locus(F.lit("chr2"), F.lit(5), F.lit(9)))
    assert got == ("██░░", "░░░░", "+3 ▲", "-2 ▼", "  =", "chr1:140.0M-166.0M", "chr2:5-9")


def test_vectors(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=9), rng.normal(size=9)
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    empty = F.array().cast("array<double>")
    cos, conc, none, pear, mse, turned, zero = one(
        spark, V.cosine(lit(a), lit(b)), V.concordance(lit(a), lit(b)), V.concordance(empty, empty),
        V.pearson_stable(lit(a), lit(b)), V.mean_squared_difference(lit(a), lit(b)),
        V.transpose_square(lit(a), 3), V.unit(lit([0.0, 0.0])))
    n = np.linalg.norm
    assert cos == pytest.approx(a @ b / ((n(a) + 1e-8) * (n(b) + 1e-8)))
    assert conc == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6) and none is None
    assert pear == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)
    assert mse == pytest.approx(((a - b) ** 2).mean())
    assert np.allclose(turned, a.reshape(3, 3).T.ravel()) and zero == [0.0, 0.0]


def test_gene_functions(spark):
    d = lambda pos: G.distance_to(F.lit(100), F.lit(200), F.lit(pos))
    assert one(spark, d(100), d(200), d(40), d(260)) == (0, 0, 60, -60)
    lab = lambda x: G.distance_label(F.lit(x))
    assert one(spark, lab(0), lab(1500), lab(-2500)) == ("overlapping", "2kb upstream", "2kb downstream")
    role = lambda g: G.cancer_role(F.lit(g))
    assert one(spark, role("myc"), role("EZH2"), role("SETD2"), role("EED"), role("CTCF"), role("TGFbeta"),
               role("ACTB")) == ("oncogene", "oncogene", "tumor_suppressor", "chromatin_regulator", "ctcf_anchor",
                                 None, None)


def test_clinical_notes(spark):
    arr = lambda *g: F.array(*[F.lit(x) for x in g]) if g else F.array().cast("array<string>")
    assert one(spark, G.boundary_note(arr("tp53", "MYC")), G.boundary_note(arr("KRAS", "BRD4", "PTEN")),
               G.boundary_note(arr("PTEN")), G.boundary_note(arr("ACTB"))) == (
        "MYC TAD boundary disruption — oncogene activation risk", "BRD4 oncogene near disrupted boundary",
        "PTEN tumor suppressor near disrupted boundary", None)
    assert one(spark, G.compartment_consequence(F.lit("B->A"), arr("A", "B", "C")),
               G.compartment_consequence(F.lit("A->B"), arr()), G.compartment_consequence(F.lit("?"), arr()),
               G.compartment_note(F.lit("A->B"), arr("PTEN")), G.compartment_note(F.lit("B->A"), arr("EED")),
               G.compartment_note(F.lit("B->A"), arr())) == (
        "Activation of A, B (heterochromatin→euchromatin)", "Gene silencing (euchromatin→heterochromatin shift)",
        "Unknown compartment change", "PTEN tumor suppressor silenced via compartment switch — high risk",
        "EED cancer gene affected by compartment switch", None)
