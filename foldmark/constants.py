"""Fixed values of the data model.

Everything in this file must equal the published values for results to agree:
word lists, thresholds, patterns and table contents. No logic lives here.
"""

# ---- fixed values: geometry and thresholds ---------------------------------
RESOLUTION = 100_000
TILE_SIZE = 256
TILE_STEP = 128
MIN_VALID_FRAC = 0.2
TELOMERE_BINS = 3
BAD_STAINS = ["acen", "gvar", "stalk"]

SIM_HIGH = 0.7
SIM_MED = 0.3
TOP_K = 5
EPS = 1e-8
FP_DIM = 64

PERMUTATIONS = 500
SEED = 42
CCRE_DELTA = 10

N_CODES = 512
EMA_GAMMA = 0.995
DEAD_THRESHOLD = 1

OE_FLOOR = 1e-6
OE_CLIP = 5.0

# ---- fixed values: vocabularies --------------------------------------------
CHROMOSOMES = [
    "chr1", "chr2", "chr3", "chr4", "chr5", "chr6", "chr7", "chr8",
    "chr9", "chr10", "chr11", "chr12", "chr13", "chr14", "chr15", "chr16",
    "chr17", "chr18", "chr19", "chr20", "chr21", "chr22", "chrX",
]

ASSAY_CODES = {"bulk_hic": 0, "micro_c": 1, "sc_hic": 2, "chia_pet": 3}

# distance-decay slopes per assay; bulk_hic is the target
ASSAY_SLOPES = {"bulk_hic": -1.2, "micro_c": -1.8, "sc_hic": -1.0}

# annotation vector order: ten counts, then six derived values
CCRE_CATEGORIES = [
    "PLS", "pELS", "dELS", "CA-CTCF", "CA-TF", "CA-H3K4me3", "CA-only",
    "High-H3K27ac", "High-H3K4me3", "Low-DNase",
]
CCRE_DEFAULT = "Low-DNase"
ANNOTATION_DERIVED = [
    "n_active", "regulatory_complexity", "ctcf_density",
    "promoter_ratio", "enhancer_ratio", "total_density",
]
# smallest absolute change that is reported, per derived value
ANNOTATION_THRESHOLDS = {
    "regulatory_complexity": 0.5,
    "ctcf_density": 0.1,
    "promoter_ratio": 0.05,
    "enhancer_ratio": 0.05,
}

# ---- fixed values: name patterns (Java regular expressions) ----------------
ACCESSION_PATTERN = (
    r"(?i)[_.]?(?:4DNF[A-Z0-9]+|ENCFF[A-Z0-9]+|ENCSR[A-Z0-9]+|GSM\d+|SRR\d+|ERR\d+)$"
)
CONDITION_PATTERN = (
    r"(?i)[_.]?(?:rep\d+|replicate\d*|r\d+(?=[_.]|$)|clone[_-]?[A-Z0-9]+"
    r"|auxin\d*(?:h|hr)?|\d+h(?:r)?(?=[_.]|$)|DMSO|IAA|degron|hom|het)[_.]?.*$"
)
EDGE_PATTERN = r"^[_.-]+|[_.-]+$"
REPLICATE_PATTERN = (
    r"(?:_rep\d+|_r\d+|_replicate\d+|_batch_?[A-Za-z\d]+|_[12345]|\.[12345])$"
)

# ---- fixed values: curated gene sets ---------------------------------------
ONCOGENES = [
    "MYC", "MYCN", "MYCL", "BCL2", "BCL6", "CCND1", "CDK4", "CDK6",
    "KRAS", "NRAS", "HRAS", "EGFR", "ERBB2", "MET", "FLT3", "KIT",
    "ABL1", "JAK2", "STAT3", "STAT5A", "STAT5B", "EZH2", "DNMT3A",
    "IDH1", "IDH2", "NPM1", "RUNX1", "GATA2", "TAL1", "LMO2", "HOX",
    "MLL", "KMT2A", "NUP214", "DEK", "ERG", "ETS1", "FUS", "EWSR1",
    "MDM2", "CDK8", "MED12", "BRD4", "FOXA1", "AR", "ESR1",
]
TUMOR_SUPPRESSORS = [
    "TP53", "RB1", "PTEN", "APC", "BRCA1", "BRCA2", "VHL", "MLH1",
    "MSH2", "MSH6", "CDKN2A", "CDKN1A", "CDKN1B", "NF1", "NF2",
    "TSC1", "TSC2", "SMAD4", "TGFbeta", "RUNX1T1", "CBFB",
    "WT1", "PTCH1", "SUFU", "BAP1", "SETD2", "KDM6A", "ARID1A",
    "SMARCA4", "SMARCB1", "CREBBP", "EP300",
]
CTCF_ANCHORS = [
    "CTCF", "RAD21", "SMC1A", "SMC3", "STAG1", "STAG2", "NIPBL", "WAPL",
]
CHROMATIN_REGULATORS = [
    "EZH2", "EZH1", "SUZ12", "EED", "DNMT3A", "DNMT3B", "TET2",
    "HDAC1", "HDAC2", "KDM1A", "KDM5C", "KDM6A", "SETD2",
    "ARID1A", "ARID1B", "SMARCA4", "SMARCB1",
]
# a name in several sets takes the first role listed here
ROLE_PRIORITY = [
    ("oncogene", ONCOGENES),
    ("tumor_suppressor", TUMOR_SUPPRESSORS),
    ("ctcf_anchor", CTCF_ANCHORS),
    ("chromatin_regulator", CHROMATIN_REGULATORS),
]

# ---- fixed values: gene table used when no annotation file is given ---------
# chrom, start, end, name; all protein_coding, strand +
FALLBACK_GENES = [
    ("chr21", 14_100_000, 14_200_000, "BRWD1"),
    ("chr21", 14_300_000, 14_460_000, "HMGN1"),
    ("chr21", 15_440_000, 15_611_000, "WRB"),
    ("chr21", 17_054_000, 17_087_000, "PTTG1IP"),
    ("chr21", 17_700_000, 17_900_000, "DSCR3"),
    ("chr21", 18_370_000, 18_420_000, "DYRK1A"),
    ("chr21", 25_888_000, 26_004_000, "KCNJ6"),
    ("chr21", 26_556_000, 26_600_000, "DSCR4"),
    ("chr21", 33_548_000, 33_635_000, "ERG"),
    ("chr21", 34_787_000, 34_856_000, "ETS2"),
    ("chr21", 35_070_000, 35_224_000, "PSMG1"),
    ("chr21", 38_380_000, 38_461_000, "B3GALT5"),
    ("chr21", 39_710_000, 39_809_000, "HMGN1"),
    ("chr21", 40_737_000, 40_818_000, "WRB"),
    ("chr21", 42_100_000, 42_231_000, "COL18A1"),
    ("chr21", 43_985_000, 44_055_000, "RUNX1"),
    ("chr21", 44_352_000, 44_534_000, "CLIC6"),
    ("chr22", 19_178_000, 19_278_000, "BCR"),
    ("chr22", 21_983_000, 22_057_000, "NF2"),
    ("chr22", 23_521_000, 23_601_000, "SMARCB1"),
    ("chr22", 24_103_000, 24_191_000, "CRKL"),
    ("chr22", 25_584_000, 25_677_000, "AIFM3"),
    ("chr22", 29_041_000, 29_130_000, "MN1"),
    ("chr22", 30_070_000, 30_140_000, "TBX1"),
    ("chr22", 36_677_000, 36_803_000, "PDGFB"),
    ("chr22", 37_339_000, 37_477_000, "MYH9"),
    ("chr22", 38_430_000, 38_510_000, "EWSR1"),
    ("chr22", 40_355_000, 40_499_000, "NEFH"),
    ("chr22", 42_400_000, 42_530_000, "EP300"),
    ("chr22", 43_088_000, 43_117_000, "SCO2"),
    ("chr22", 44_539_000, 44_624_000, "BRCA2"),
    ("chr22", 45_790_000, 45_944_000, "PARVB"),
]

# ---- fixed values: sample registry used when discovery finds nothing --------
# sample_id, file, assay, tissue
FALLBACK_SAMPLES = [
    ("HeLa-S3", "HeLa-S3_4DNFIBM9QCFG.mcool", "bulk_hic", "cervical_cancer"),
    ("IMR-90", "IMR-90_4DNFIJTOIGOI.mcool", "bulk_hic", "lung_fibroblast"),
    ("K562", "K562_4DNFI18UHVRO.mcool", "bulk_hic", "leukemia"),
    ("KBM-7", "KBM-7_4DNFI5IHU27G.mcool", "bulk_hic", "leukemia"),
    ("foreskin_fibroblast", "foreskin_fibroblast_4DNFIQJQY7PW.mcool", "bulk_hic", "fibroblast"),
]
FALLBACK_ANNOTATIONS = [
    ("HeLa-S3", "HeLa-S3_ENCFF960YUI.bed.gz"),
    ("IMR-90", "IMR-90_ENCFF685BXB.bed.gz"),
    ("K562", "K562_ENCFF455VKH.bed.gz"),
    ("KBM-7", "KBM-7_ENCFF141FBS.bed.gz"),
    ("foreskin_fibroblast", "foreskin_fibroblast_ENCFF422UQT.bed.gz"),
]
