"""Shared text of the oracles: the fixture views and common steps as CTEs."""

from pyspark.sql import functions as F

from ..fixtures import SQL, Fixture

_CTE = dict(SQL)
_CTE.update({
    "tokens": """
SELECT vec_id, pos, embedding[pos*8+1:pos*8+8] AS token
FROM (SELECT vec_id, embedding, unnest(range(0,8)) AS pos FROM embeddings)""",
    "codebook": "SELECT CAST(vec_id AS INTEGER) AS code, embedding[1:8] AS vec FROM embeddings WHERE vec_id < 16",
    "bins": """
SELECT sample_id, chrom, bin, CASE WHEN bin % 17 <> 0 THEN 1.0E0/(3 + bin % 10) END AS weight
FROM (SELECT DISTINCT sample_id, chrom FROM pixels), (SELECT unnest(range(0,96)) AS bin)""",
    # vectors in double with their length, and the sample attributes
    "members": """
SELECT f.id, f.sample_id, f.chr, f.start_bp, f.end_bp, CAST(f.fingerprint AS DOUBLE[]) AS v,
  sqrt(list_dot_product(CAST(f.fingerprint AS DOUBLE[]), CAST(f.fingerprint AS DOUBLE[]))) + 1e-8 AS len,
  f.label, s.cell_type, s.tissue, s.role
FROM fingerprints f JOIN samples s USING (sample_id)""",
    "locus_pairs": """
SELECT q.sample_id, q.chr, q.start_bp, q.end_bp, r.sample_id AS match_sample, r.cell_type AS match_cell_type,
  r.tissue AS match_tissue, list_dot_product(q.v, r.v)/(q.len*r.len) AS score
FROM members q JOIN members r ON q.chr = r.chr AND q.start_bp = r.start_bp
WHERE q.role = 'query' AND r.role = 'ref'""",
    "locus_ranked": """
SELECT *, row_number() OVER (PARTITION BY sample_id, chr, start_bp ORDER BY score DESC, match_sample) AS rank
FROM locus_pairs""",
    "win": """
SELECT sample_id, chr, start_bp, end_bp, score AS similarity, match_sample AS top_sample,
  match_cell_type AS top_cell_type,
  CASE WHEN score > 0.7 THEN 'STRUCTURALLY_SIMILAR' WHEN score > 0.3 THEN 'PARTIALLY_SIMILAR'
       ELSE 'STRUCTURALLY_DIFFERENT' END AS status
FROM locus_ranked WHERE rank = 1""",
    "all_pairs": """
SELECT q.sample_id, q.id, q.chr, q.start_bp, q.end_bp, r.cell_type, r.id AS rid,
  list_dot_product(q.v, r.v)/(q.len*r.len) AS score
FROM members q, members r WHERE q.role = 'query' AND r.role = 'ref'""",
    "type_best": """
SELECT sample_id, id, chr, start_bp, end_bp, cell_type, max(score) AS score
FROM all_pairs GROUP BY ALL""",
    "overall_best": """
SELECT sample_id, id, cell_type FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rid) AS rn FROM all_pairs) WHERE rn = 1""",
    "type_mean": """
SELECT m.sample_id, m.cell_type, m.similarity, m.n_tiles, coalesce(w.loci_won, 0) AS loci_won,
  row_number() OVER (PARTITION BY m.sample_id ORDER BY m.similarity DESC, m.cell_type) AS rank
FROM (SELECT sample_id, cell_type, avg(score) AS similarity, count(*) AS n_tiles FROM type_best GROUP BY 1,2) m
LEFT JOIN (SELECT sample_id, cell_type, count(*) AS loci_won FROM overall_best GROUP BY 1,2) w
  USING (sample_id, cell_type)""",
    "ccre_clean": """
SELECT sample_id, chrom, start_bp, end_bp,
  CASE WHEN category = 'Unclassified' THEN 'Low-DNase' ELSE category END AS category FROM ccre""",
    "loci": "SELECT DISTINCT chr, start_bp, end_bp FROM fingerprints",
    "windows": """
SELECT DISTINCT cell_type AS sample_id, chr AS chrom, start_bp AS win_start, end_bp AS win_end FROM members""",
    "gene_roles": """
SELECT *, CASE gene_name WHEN 'MYC' THEN 'oncogene' WHEN 'TP53' THEN 'tumor_suppressor' WHEN 'CTCF' THEN 'ctcf_anchor'
  WHEN 'EED' THEN 'chromatin_regulator' WHEN 'EZH2' THEN 'oncogene' END AS cancer_role FROM genes""",
})
_NEEDS = {
    "bins": ["pixels"],
    "members": ["fingerprints", "samples"],
    "locus_pairs": ["members"], "locus_ranked": ["locus_pairs"], "win": ["locus_ranked"],
    "all_pairs": ["members"], "type_best": ["all_pairs"], "overall_best": ["all_pairs"],
    "type_mean": ["type_best", "overall_best"],
    "ccre_clean": ["ccre"], "loci": ["fingerprints"], "windows": ["members"], "gene_roles": ["genes"],
}


def define(name, text, needs=()):
    """Add a named step usable by later oracles."""
    _CTE[name] = text
    _NEEDS[name] = list(needs)


def oracle(body, *views):
    """The body behind a WITH clause holding the named views and what they need."""
    order = []

    def add(name):
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    steps = ",\n".join(f"{n} AS ({_CTE[n].strip()})" for n in order)
    if "{steps}" in body:  # a body with a WITH RECURSIVE of its own
        return body.replace("{steps}", steps).strip()
    return f"WITH {steps}\n{body.strip()}" if order else body.strip()


def registry():
    """An empty (queries, oracles) pair and the decorator that fills it."""
    queries, oracles = {}, {}

    def register(name, sql=None, views=()):
        def wrap(fn):
            queries[name] = lambda spark, directory: fn(Fixture(spark, directory))
            if sql is not None:
                oracles[name] = (sql, views)
            return fn
        return wrap

    return queries, oracles, register


def r6(name):
    """Rounded to six places, never minus zero."""
    return (F.round(F.col(name), 6) + F.lit(0.0)).alias(name)
