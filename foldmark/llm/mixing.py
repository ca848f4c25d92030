"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words. Sources in code-point order (null last)
weigh WEIGHTS, repeating, and share SHARE of all sizes; a target stops at MOST times
its source's size and the excess is shared again by weight until none is above.

A source is taken in whole epochs first. For the fraction that is left each
document gets the exponential key -ln(u) / w, with u from a hash of its id and w its
quality (words over words and symbols); documents are taken in the order of their keys while the
middle of their span in the prefix sum stays within the budget, so the sum misses it by half
a document at most.

No source is sorted as a whole: keys are counted into 4096 ranges, the range that
holds the budget again into 4096, and only documents of that last range are ordered.

Rows: null text counts as empty (size 0, never taken); a row without doc_id has its
key from the text 'null'. Repeated rows have one key and stand next to each
other. Extra columns are ignored; an empty table gives an empty result.
"""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, apart, stored

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SYMBOLS = "#*$%&|<>"
_STEP = 4096
SENT_SOURCES = 100_000  # tables of one row per source go to the tasks whole up to so many sources, and are joined by shuffle beyond


def targets(sizes, weights, share=SHARE, most=MOST):
    """Target words of each source, in the order given."""
    cap = [most * s for s in sizes]
    held = [False] * len(sizes)
    out = [0.0] * len(sizes)
    while not all(held):
        left = share * sum(sizes) - sum(c for c, h in zip(cap, held, strict=True) if h)
        level = left / sum(w for w, h in zip(weights, held, strict=True) if not h)
        over = [not h and w * level > c for c, w, h in zip(cap, weights, held, strict=True)]
        if not any(over):
            return [float(c) if h else w * level for c, w, h in zip(cap, weights, held, strict=True)]
        held = [h or o for h, o in zip(held, over, strict=True)]
    return [float(c) for c in cap]


def row_key(docs):
    """Hash of a row's id, source and text; rows alike in all three can stand for each other."""
    own = ["doc_id", "source", "text"]
    return F.xxhash64(*[docs[c] for c in own], *[docs[c].isNull() for c in own])


def measured(docs):
    """doc_id, source, size, sampling key and row key of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    digits = F.substring(F.md5(F.concat(F.lit("mix "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
                               .cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4503599627370496.0)
    quality = F.when(F.col("size") > 0, F.col("size") / (F.col("size") + F.col("symbols"))).otherwise(F.lit(1.0))
    return (docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"),
                        symbols.alias("symbols"), u.alias("u"), row_key(docs).alias("row_key"))
            .select("doc_id", "source", "size", (-F.log("u") / quality).alias("key"), "row_key"))


def _boundary(rows, digit, budget):
    """Per source the range in which the prefix sum passes the budget, and the sum before it."""
    w = Window.partitionBy("name").orderBy(digit)
    return (rows.groupBy("name", digit).agg(F.sum("size").alias("part"), F.first(budget).alias("budget"))
            .withColumn("upto", F.sum("part").over(w))
            .where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("part") <= F.col("budget")))
            .select("name", F.col(digit).alias(f"{digit}_cut"), (F.col("upto") - F.col("part")).alias(f"{digit}_sum")))


def mix(docs, weights=WEIGHTS, share=SHARE, most=MOST, keyed=False):
    """One row per row of ``docs``: doc_id, source, size, source_size, target, times, taken (and its row_key, if ``keyed``)."""
    spark = docs.sparkSession
    rows = stored(measured(docs), "mix-sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).toArrow().to_pydict()
    order = sorted(zip(found["source"], found["n"], strict=True), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    sizes = [n for _, n in order]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, most)
    whole = [int(g // n) if n else 0 for g, n in zip(goal, sizes, strict=True)]
    plan = spark.createDataFrame(pa.table({
        "name": pa.array(["=" + s if s is not None else "" for s, _ in order], pa.string()),
        "source_size": pa.array(sizes, pa.int64()), "target": pa.array(goal, pa.float64()),
        "epochs": pa.array(whole, pa.int64()),
        "rest": pa.array([g - e * n for g, e, n in zip(goal, whole, sizes, strict=True)], pa.float64())}))
    sent = F.broadcast if len(order) <= SENT_SOURCES else lambda df: df
    place = F.col("key") / (F.col("key") + 1) * _STEP
    named = (rows.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
             .join(sent(plan), "name").withColumn("high", F.floor(place))
             .withColumn("low", F.floor((place - F.floor(place)) * _STEP)))
    first = _boundary(named, "high", "rest")
    inside = (named.join(sent(first), "name").where("high = high_cut")
              .withColumn("room", F.col("rest") - F.col("high_sum")))
    second = _boundary(inside, "low", "room")
    cuts = first.join(second, "name", "left")
    cut = named.join(sent(cuts), "name", "left")
    at = (F.col("high") == F.col("high_cut")) & (F.col("low") == F.col("low_cut"))
    before = F.coalesce((F.col("high") < F.col("high_cut"))
                        | ((F.col("high") == F.col("high_cut")) & (F.col("low") < F.col("low_cut"))), F.lit(False))
    columns = ["doc_id", "source", "size", "source_size", "target"] + ["row_key"] * keyed
    w = Window.partitionBy("name").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = (cut.where(at).withColumn("done", F.coalesce(F.sum("size").over(w), F.lit(0)))
            .withColumn("one", F.col("done") + F.col("size") / 2 <= F.col("rest") - F.col("high_sum") - F.col("low_sum")))
    rest = cut.where(F.coalesce(~at, F.lit(True))).withColumn("one", before)
    times = (F.col("epochs") + F.col("one").cast("long")).alias("times")
    out = last.select(*columns, times).unionByName(rest.select(*columns, times))
    return out.withColumn("times", F.when(F.col("size") > 0, F.col("times")).otherwise(F.lit(0)).cast("long")) \
        .withColumn("taken", F.col("size") * F.col("times"))


def mixed_rows(docs):
    """``docs`` with every row as often as the mix takes it, all columns kept.

    Rows alike in id, source and text share the times of all of them. Other columns may have any name.
    """
    docs, restored = apart(docs, "doc_id", "source", "text")
    times = stored(mix(docs, keyed=True).groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_of"))
                   .agg(F.sum("times").alias("_times"), F.count(F.lit(1)).alias("_rows")).where("_times > 0"), "mix-times")

    def met(times):
        return docs.withColumn("_key", row_key(docs)).join(
            times, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of")))

    each, more = F.floor(F.col("_times") / F.col("_rows")), F.col("_times") % F.col("_rows")
    out = met(times.where(more == 0)).withColumn("_n", each.cast("int"))
    uneven = times.where(more != 0)
    if not uneven.isEmpty():
        w = Window.partitionBy("_id", "_of").orderBy(F.xxhash64(*docs.columns))
        out = out.unionByName(met(uneven).withColumn("_place", F.row_number().over(w)).withColumn(
            "_n", (each + (F.col("_place") <= more).cast("int")).cast("int")).drop("_place"))
    return out.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).transform(restored)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS symbols,
    (CAST('0x' || substr(md5('mix ' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS u
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln(u) / CASE WHEN size > 0 THEN size / CAST(size + symbols AS DOUBLE) ELSE 1.0::DOUBLE END AS key FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM keyed GROUP BY source),
levels AS (
  SELECT *, 2 * source_size AS cap,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / CAST(w AS DOUBLE), source
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(w) OVER (ORDER BY 2 * source_size / CAST(w AS DOUBLE), source
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM sources),
level AS (SELECT arg_min(level, cap / CAST(w AS DOUBLE)) AS level FROM levels WHERE w * level <= cap),
goals AS (
  SELECT source, source_size, CASE WHEN w * level.level > cap THEN CAST(cap AS DOUBLE) ELSE w * level.level END AS target
  FROM levels, level),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals),
summed AS (
  SELECT k.*, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN epochs + CASE WHEN done + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS times,
  CAST(size * CASE WHEN size > 0 THEN epochs + CASE WHEN done + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS taken
FROM summed
"""
