"""The library's scalar functions and the window-to-elements table function under names usable in ``spark.sql``."""

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from .. import constants as C

# fixed texts and bounds, as in functions/labels.py
SCALARS = {
    "similarity_status(s DOUBLE) RETURNS STRING": f"""CASE WHEN s > {C.SIM_HIGH}D THEN 'STRUCTURALLY_SIMILAR'
        WHEN s > {C.SIM_MED}D THEN 'PARTIALLY_SIMILAR' ELSE 'STRUCTURALLY_DIFFERENT' END""",
    "confidence_badge(s DOUBLE) RETURNS STRING": """CASE WHEN s >= 0.90D THEN 'VERY HIGH ★★★' WHEN s >= 0.80D THEN 'HIGH     ★★☆'
        WHEN s >= 0.65D THEN 'MEDIUM   ★☆☆' ELSE 'LOW      ☆☆☆' END""",
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        f"vector_dot(a, b) / ((sqrt(vector_dot(a, a)) + {C.EPS}D) * (sqrt(vector_dot(b, b)) + {C.EPS}D))",
    "vector_centred(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>":
        "transform(a, x -> x - aggregate(a, 0D, (s, y) -> s + y) / size(a))",
    "profile_concordance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": f"""vector_dot(vector_centred(a), vector_centred(b))
        / (sqrt(vector_dot(vector_centred(a), vector_centred(a)) * vector_dot(vector_centred(b), vector_centred(b))) + {C.EPS}D)""",
}


@arrow_udtf(returnType="sample_id string, chrom string, win_start bigint, win_end bigint, category string, start_bp bigint, end_bp bigint")
class WindowElements:
    """Elements that overlap each window, from one table of both kinds partitioned by sample, chromosome and grid cell.

    Rows have sample_id, chrom, cell, kind (0 window, 1 element), start_bp, end_bp, category and first (the row's first cell); a pair comes
    out in the first cell that both have. The windows of a cell are kept, elements stream past, so order by kind.
    """

    def __init__(self):
        self.windows = []

    def eval(self, rows: pa.RecordBatch):
        kind = rows.column("kind").to_numpy()
        if (kind == 0).any():
            self.windows.append(rows.filter(pa.array(kind == 0)))
        elements = rows.filter(pa.array(kind == 1))
        if not self.windows or not elements.num_rows:
            return
        windows = pa.Table.from_batches(self.windows).combine_chunks()
        number = lambda t, c: t.column(c).to_numpy()
        cell = number(elements, "cell")
        for a in range(0, elements.num_rows, 4096):
            e = elements.slice(a, 4096)
            meets = ((number(e, "start_bp")[:, None] < number(windows, "end_bp")[None, :])
                     & (number(e, "end_bp")[:, None] > number(windows, "start_bp")[None, :])
                     & (cell[a:a + 4096, None] == np.maximum(number(e, "first")[:, None], number(windows, "first")[None, :])))
            i, j = (pa.array(x) for x in np.nonzero(meets))
            w, e = windows.take(j), pa.Table.from_batches([e]).take(i)
            yield pa.table({
                "sample_id": w["sample_id"], "chrom": w["chrom"], "win_start": w["start_bp"], "win_end": w["end_bp"],
                "category": e["category"], "start_bp": e["start_bp"], "end_bp": e["end_bp"]})


def register(spark: SparkSession):
    """Register all of them as temporary functions of the session."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("window_elements", WindowElements)


#: Text of a query over the views ``windows`` (sample_id, chrom, win_start, win_end) and ``elements`` (sample_id, chrom, start_bp, end_bp, category).
ELEMENTS_OF_WINDOWS = """
SELECT * FROM window_elements(TABLE(
  SELECT sample_id, chrom, explode(sequence(first, greatest(first, (end_bp - 1) div 12800000))) AS cell, kind, start_bp, end_bp, category, first
  FROM (SELECT sample_id, chrom, 0 AS kind, win_start AS start_bp, win_end AS end_bp, CAST(NULL AS STRING) AS category,
      win_start div 12800000 AS first FROM windows
    UNION ALL SELECT sample_id, chrom, 1, start_bp, end_bp, category, start_bp div 12800000 FROM elements))
  PARTITION BY (sample_id, chrom, cell) ORDER BY kind)
"""
