"""Chat formatting with collapse of cumulative snapshots.

Logged conversations often repeat an earlier log and add turns. Every prefix of a
conversation has a rolling hash: three running sums of 40-bit hashes of (position, role, text),
so a prefix costs one row of a window and no text. A conversation that equals a prefix of a longer one is
dropped by an anti-join on (turns, hashes); equal conversations are reduced to the one with
the lowest id first. What is left, the maximal conversations, is rendered.

Prefix hashes are made distinct before the join, so a first turn that most
conversations share is one row per task.

Rows: a conversation's turns are ordered by turn (nulls last), then role, then text; rows that
repeat in full count once. A null role or text counts as empty. Rows without conv_id
are ignored, extra columns too. An empty table gives an empty result. Turn texts of any length are
hashed and rendered whole. Markers of the template inside a text are broken up ("<|" becomes "< |").
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["turns", "a", "b", "c"]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(conversations):
    """Numbered turns with the rolling hashes of the prefix that each one ends."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", empty("role"), empty("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("turns", F.row_number().over(order).cast("long"))
    by_turn = Window.partitionBy("conv_id").orderBy("turns")
    upto = by_turn.rowsBetween(Window.unboundedPreceding, 0)
    low = lambda seed: F.xxhash64(F.lit(seed), "turns", "role", "text").bitwiseAND(F.lit((1 << 40) - 1))
    return rows.select("conv_id", "turns", "role", "text", *[F.sum(low(s)).over(upto).alias(n) for s, n in enumerate("abc")],
                       F.lead("turns").over(by_turn).isNull().alias("ends"))


def maximal(turns):
    """conv_id, turns and copies of the conversations that prefix no longer one."""
    whole = turns.where("ends").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    parts = turns.where("NOT ends").select(*KEY).distinct()
    return whole.join(parts, KEY, "left_anti").select("conv_id", "turns", "copies")


def rendered(conversations):
    """conv_id, n_turns, copies and the chat text of every maximal conversation."""
    turns = prefixes(conversations)
    kept = maximal(turns)
    plain = lambda c: F.replace(F.col(f"t.{c}"), F.lit("<|"), F.lit("< |"))
    one = F.concat(F.lit(OPEN), plain("role"), F.lit("\n"), plain("text"), F.lit(CLOSE + "\n"))
    texts = (turns.join(kept.select("conv_id"), "conv_id", "left_semi")
             .select("conv_id", F.struct("turns", "role", "text").alias("t"))
             .select("conv_id", F.struct("t.turns", one.alias("one")).alias("part"))
             .groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts")))
    return kept.join(texts, "conv_id").select(
        "conv_id", F.col("turns").alias("n_turns"), "copies", F.array_join("parts.one", "").alias("chat"))


ORACLE = r"""
WITH rows AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
logs AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS LAST, role, text) AS turns, count(*) AS n
  FROM rows GROUP BY conv_id),
parts AS (SELECT DISTINCT turns[1:k] AS part FROM (SELECT turns, unnest(range(1, n)) AS k FROM logs)),
whole AS (SELECT turns, n AS n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM logs GROUP BY turns, n)
SELECT conv_id, n_turns, copies, array_to_string(list_transform(turns, lambda t: '<|im_start|>' || replace(t.role, '<|', '< |') || chr(10)
    || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS chat
FROM whole ANTI JOIN parts ON turns = part
"""
