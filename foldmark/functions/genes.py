"""Gene columns: role, signed distance, labels, clinical notes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def cancer_role(gene_name: Column) -> Column:
    """First role whose set holds the upper-cased name, else NULL."""
    name = F.upper(gene_name)
    return F.coalesce(*[F.when(name.isin(members), F.lit(role)) for role, members in C.ROLE_PRIORITY])


def distance_to(start: Column, end: Column, pos: Column) -> Column:
    """0 inside [start, end]; positive when the position lies before the gene, negative after it."""
    return F.when(pos < start, start - pos).when(pos > end, end - pos).otherwise(F.lit(0)).cast("long")


def distance_label(distance: Column) -> Column:
    kb = F.concat(F.bround(F.abs(distance) / 1000).cast("long").cast("string"), F.lit("kb"))
    return F.when(distance == 0, "overlapping").when(distance > 0, F.concat(kb, F.lit(" upstream"))).when(
        distance < 0, F.concat(kb, F.lit(" downstream")))


def in_window(gene_start: Column, gene_end: Column, start: Column, end: Column) -> Column:
    return gene_start.between(start, end) | gene_end.between(start, end) | (
        (gene_start <= start) & (start <= gene_end))


def _set(values):
    return F.array(*[F.lit(v) for v in values])


def boundary_note(names: Column) -> Column:
    """Clinical note for a lost boundary; among several set members the first by name."""
    up = F.transform(names, F.upper)
    onco = F.array_min(F.array_intersect(up, _set(C.ONCOGENES)))
    supp = F.array_min(F.array_intersect(up, _set(C.TUMOR_SUPPRESSORS)))
    # fixed values: wording of the notes
    named = [
        ("MYC", "MYC TAD boundary disruption — oncogene activation risk"),
        ("RUNX1", "RUNX1 boundary loss — leukemia-associated"),
        ("TP53", "TP53 TAD disruption — tumor suppressor dysregulation"),
        ("CTCF", "CTCF gene boundary loss — genome organization disruption"),
        ("BCL2", "BCL2 boundary disruption — anti-apoptosis dysregulation"),
    ]
    return F.coalesce(*[F.when(F.array_contains(up, g), F.lit(text)) for g, text in named],
                      F.concat(onco, F.lit(" oncogene near disrupted boundary")),
                      F.concat(supp, F.lit(" tumor suppressor near disrupted boundary")))


def compartment_consequence(direction: Column, cancer_genes: Column) -> Column:
    two = F.array_join(F.slice(cancer_genes, 1, 2), ", ")
    some = F.size(cancer_genes) > 0
    up, down = "(heterochromatin→euchromatin", "(euchromatin→heterochromatin"

    def text(verb, noun, shift):
        return F.when(some, F.concat(F.lit(f"{verb} of "), two, F.lit(f" {shift})"))).otherwise(
            F.lit(f"Gene {noun} {shift} shift)"))

    return (F.when(direction == "B->A", text("Activation", "activation", up))
            .when(direction == "A->B", text("Silencing", "silencing", down))
            .otherwise("Unknown compartment change"))


def compartment_note(direction: Column, cancer_genes: Column) -> Column:
    """Clinical note from the first cancer gene of the region; NULL without one."""
    g = F.upper(F.get(cancer_genes, F.lit(0)))
    onco, supp = g.isin(C.ONCOGENES), g.isin(C.TUMOR_SUPPRESSORS)
    # fixed values: wording of the notes
    to_a = (F.when(onco, F.concat(g, F.lit(" oncogene activation via compartment switch — high risk")))
            .when(supp, F.concat(g, F.lit(" tumor suppressor activated — potential protective effect"))))
    to_b = (F.when(supp, F.concat(g, F.lit(" tumor suppressor silenced via compartment switch — high risk")))
            .when(onco, F.concat(g, F.lit(" oncogene silenced — potential protective effect"))))
    return F.coalesce(F.when(direction == "B->A", to_a), F.when(direction == "A->B", to_b),
                      F.concat(g, F.lit(" cancer gene affected by compartment switch")))
