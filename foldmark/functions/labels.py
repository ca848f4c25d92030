"""Labels, verdicts and display text derived from scores.

The texts and bounds are fixed values.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _ladder(value, steps, otherwise, strict=True):
    """First label whose lower bound the value passes."""
    out = None
    for bound, label in steps:
        hit = value > bound if strict else value >= bound
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def similarity_class(score: Column) -> Column:
    """Bounds are exclusive: exactly 0.7 is partial, exactly 0.3 is different."""
    return _ladder(score, [(C.SIM_HIGH, "STRUCTURALLY_SIMILAR"), (C.SIM_MED, "PARTIALLY_SIMILAR")],
                   "STRUCTURALLY_DIFFERENT")


def similarity_class_inclusive(score: Column) -> Column:
    """Held-out variant: exactly 0.3 is partial, exactly 0.7 is similar."""
    return _ladder(score, [(C.SIM_HIGH, "STRUCTURALLY_SIMILAR"), (C.SIM_MED, "PARTIALLY_SIMILAR")],
                   "STRUCTURALLY_DIFFERENT", strict=False)


def chromosome_status(mean_score: Column) -> Column:
    return _ladder(mean_score, [(C.SIM_HIGH, "STRUCTURALLY_SIMILAR"), (C.SIM_MED, "PARTIALLY_SIMILAR")],
                   "DIVERGENT")


def window_status(score: Column) -> Column:
    return _ladder(score, [(C.SIM_HIGH, "SIMILAR"), (C.SIM_MED, "PARTIAL")], "DIVERGENT", strict=False)


def confidence_badge(score: Column) -> Column:
    return _ladder(score, [(0.90, "VERY HIGH ★★★"), (0.80, "HIGH     ★★☆"), (0.65, "MEDIUM   ★☆☆")],
                   "LOW      ☆☆☆", strict=False)


def pair_verdict(mean_score: Column) -> Column:
    return _ladder(mean_score, [(0.95, "STRUCTURALLY IDENTICAL"), (0.88, "VERY SIMILAR"), (0.75, "SIMILAR")],
                   "DIFFERENT")


def retrieval_verdict(recall5: Column) -> Column:
    return _ladder(recall5, [(0.8, "EXCELLENT — publication ready"), (0.65, "GOOD — suitable for retrieval"),
                             (0.45, "FAIR — usable but needs improvement")],
                   "POOR — needs more training", strict=False)


def retrieval_grade(recall5: Column) -> Column:
    return _ladder(recall5, [(0.7, "EXCELLENT"), (0.5, "GOOD"), (0.3, "FAIR")], "POOR", strict=False)


def replicate_confidence(mean_score: Column) -> Column:
    return _ladder(mean_score, [(0.8, "high"), (0.5, "medium")], "low")


def spread_confidence(std: Column) -> Column:
    return F.when(std < 0.05, "high").when(std < 0.15, "medium").otherwise("low")


def boundary_concordance_label(r: Column) -> Column:
    return F.when(r.isNotNull(), _ladder(r, [(0.7, "high"), (0.3, "medium")], "low", strict=False))


def compartment_concordance_label(r: Column) -> Column:
    return F.when(r.isNotNull(), _ladder(r, [(0.7, "high"), (0.4, "medium"), (0.2, "low")],
                                         "very low", strict=False))


def is_divergent(mean_score: Column) -> Column:
    return mean_score < F.lit(C.SIM_MED)


def bar(score: Column, width: int = 20) -> Column:
    """Filled and empty blocks; half-even rounding, as Python's round."""
    filled = F.bround(score * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def change_arrow(d: Column) -> Column:
    n = d.cast("string")
    return F.when(d > 0, F.concat(F.lit("+"), n, F.lit(" ▲"))).when(
        d < 0, F.concat(n, F.lit(" ▼"))).otherwise("  =")


def locus(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def locus_mb(chrom: Column, start: Column, end: Column) -> Column:
    """Whole megabases, printed with one decimal (always .0)."""
    def mb(x):
        return F.floor(x / 1_000_000).cast("double")
    return F.format_string("%s:%.1fM-%.1fM", chrom, mb(start), mb(end))


def same_name(predicted: Column, actual: Column) -> Column:
    return F.lower(predicted) == F.lower(actual)


def random_recall(n_classes: Column, k: int = 5) -> Column:
    """Chance level of Recall@k with equally frequent classes."""
    return F.lit(1.0) - F.pow(F.lit(1.0) - F.lit(1.0) / n_classes, F.lit(float(k)))
