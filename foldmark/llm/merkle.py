"""Merkle manifest of a documents table by sibling-shift self-joins.

Every row is a leaf: the SHA-256 of its fields, each with its length in bytes. The leaves of a language, ordered by doc_id,
form a tree with runs of FAN nodes; the language roots, ordered by name, form one more tree on top.

A level is a table (tree, idx, n, digest). Each node asks for the FAN slots of its run by computed index (the XOR of
the index for two-node runs, shifted slots otherwise), one equijoin on (tree, idx) answers, and the answers grouped by
asker give every node the digests before and after it in its run. The rows in slot zero then emit
the parents. A level is FAN times smaller than the one before, so rounds are log_FAN of the largest tree, and a level's key
is unique: no language, however large, makes a hot task.

Proofs go back down: a node's siblings are put before those of its parent, over the parent's index. Digests travel as 32
bytes and are hashed as hex text.

Rows: nulls have a leaf of their own ("-"), a null doc_id comes first in its tree, a null language is a tree, an empty text
is "0:". Rows that repeat are leaves of their own; rows that share a doc_id are ordered by leaf. Texts of any length are hashed
whole. Extra columns are ignored; an empty table gives an empty result.
"""

from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import CRC_TABLE, LOWER, UPPER, crc_sql, stored

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = ("tree", "idx", "n", "digest")


def field(value):
    """UTF-8 byte count, colon and value; "-" for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def hexed(digest):
    return F.lower(F.hex(digest))


def leaf(text):
    """Digest of a row as 32 bytes, with ``text`` in the place of its text."""
    return F.unhex(F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256))


def is_tampered(doc_id):
    """Every third row by the CRC-32 of its id; a row without id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs):
    """doc_id, tree (language), digest and the digest after tampering of every row."""
    text = F.col("text")
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null sorts first and differs from any name
    tampered = F.when(is_tampered(F.col("doc_id")), leaf(F.translate(text, UPPER, LOWER)))
    return docs.select("doc_id", tree.alias("tree"), leaf(text).alias("digest"), tampered.alias("tampered"))


def with_siblings(nodes, fan):
    """Every node of ``nodes`` with the joined digests before and after it in its run.

    A node asks for the ``fan`` slots of its run; the join with the level itself answers.
    """
    slot = F.pmod("idx", F.lit(fan))
    offset = F.explode(F.array(*[F.lit(k).cast("long") for k in range(fan)])).alias("offset")
    sibling = F.col("idx").bitwiseXOR(F.col("offset")) if fan == 2 else (
        F.col("idx") - slot + F.pmod(slot + F.col("offset"), F.lit(fan)))
    asked = (nodes.select("tree", "idx", "n", offset)
             .select("tree", F.col("idx").alias("asker"), "n", sibling.alias("idx")).where("idx < n"))
    answers = (asked.join(nodes.select("tree", "idx", "digest"), ["tree", "idx"])
               .groupBy("tree", "asker", "n").agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run")))

    def joined(keep):
        part = F.transform(F.filter("run", keep), lambda s: hexed(s["digest"]))
        return F.unhex(F.array_join(part, "")).alias

    own = F.filter("run", lambda s: s["idx"] == F.col("asker"))[0]["digest"]
    return answers.select("tree", F.col("asker").alias("idx"), "n", own.alias("digest"),
                          joined(lambda s: s["idx"] < F.col("asker"))("left"),
                          joined(lambda s: s["idx"] > F.col("asker"))("right"))


def parents(level, fan):
    """The next level, from the rows in slot zero."""
    digest = F.unhex(F.sha2(F.concat(hexed(F.col("digest")), hexed(F.col("right"))), 256))
    return level.where(F.pmod("idx", F.lit(fan)) == 0).select(
        "tree", F.floor(F.col("idx") / fan).cast("long").alias("idx"),
        F.ceil(F.col("n") / fan).cast("long").alias("n"), digest.alias("digest"))


def climbed(nodes, fan=FAN):
    """(levels with siblings, roots per level) of all trees of ``nodes`` (tree, idx, n, digest)."""
    levels, roots = [], []
    while True:
        roots.append(nodes.where("n = 1"))
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            return levels, roots
        levels.append(stored(with_siblings(nodes, fan), "merkle-level"))
        nodes = stored(parents(levels[-1], fan), "merkle-nodes")


def proofs(levels, roots, above, fan=FAN):
    """tree, idx of every leaf with the columns of ``above`` of its tree, its siblings put before ``above``'s ``path``.

    ``above`` has one row per tree: tree, path (left and right digests level by level) and whatever else
    leaves shall carry.
    """
    def rest(prefix=""):
        return [F.col(prefix + c) for c in above.columns if c not in ("tree", "path")]

    known = [r.select("tree", "idx").join(above, "tree") for r in roots]
    paths = known[-1]
    for level, root in zip(reversed(levels), reversed(known[:-1]), strict=True):
        up = paths.withColumnRenamed("idx", "block")
        step = F.array(F.struct("left", "right"))
        paths = (level.withColumn("block", F.floor(F.col("idx") / fan).cast("long")).join(up, ["tree", "block"])
                 .select("tree", "idx", F.concat(step, "path").alias("path"), *rest()))
        paths = paths.unionByName(root.select(*paths.columns))
    return paths


def folded(digest, path):
    """Root that ``digest`` gives with the siblings of ``path``."""
    return F.aggregate(path, digest, lambda d, s: F.unhex(
        F.sha2(F.concat(hexed(s["left"]), hexed(d), hexed(s["right"])), 256)))


def manifest(docs, fan=FAN):
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = stored(leaves(docs).withColumn("place", F.monotonically_increasing_id()), "merkle-leaves")
    rows = stored(numbered(rows, ["doc_id", "digest", "place"], ["tree"], "idx", total="n"), "merkle-rows")
    levels, roots = climbed(rows.select(*NODE), fan)
    subroots = roots[0]
    for r in roots[1:]:
        subroots = subroots.unionByName(r)
    subroots = stored(subroots.select("tree", "digest"), "merkle-subroots")
    names = stored(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"], ["tree"], "idx",
                            total="n"), "merkle-top")
    top_levels, top_roots = climbed(names.select(*NODE), fan)
    top = top_roots[-1].select("tree", F.col("digest").alias("root"), F.expr(
        "cast(array() AS array<struct<left: binary, right: binary>>)").alias("path"))
    above = names.join(proofs(top_levels, top_roots, top, fan), ["tree", "idx"]).select(
        F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    paths = proofs(levels, roots, stored(above, "merkle-above"), fan)
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), ""), 256)
    again = folded(F.coalesce("tampered", "digest"), F.col("path"))
    return (rows.join(paths, ["tree", "idx"])
            .select("doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"),
                    hexed(F.col("root")).alias("root"), proof.alias("proof_sha256"), again.alias("folded"))
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", hexed(F.col("folded")).alias("folded_root"),
                    (hexed(F.col("folded")) == F.col("root")).alias("verified")))


def _field(c):
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"


def _leaf(text):
    return "sha256(" + " || ".join(_field(text if c == "text" else c) for c in FIELDS) + ")"


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {crc_sql("doc_id::VARCHAR")} % 3 = 0
    THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered FROM documents, crc_table),
placed AS (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM placed
  UNION ALL SELECT tree, lvl + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes
    WHERE n > 1 GROUP BY tree, lvl, idx // {FAN}, n),
named AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, idx, n, h FROM named
  UNION ALL SELECT lvl + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY idx)) FROM tops
    WHERE n > 1 GROUP BY lvl, idx // {FAN}, n),
depth AS (SELECT tree, max(lvl) AS d FROM nodes GROUP BY tree),
ups AS (SELECT p.tree, p.idx AS leaf_at, o.lvl, o.h, o.idx AS place, p.idx // CAST({FAN} ** o.lvl AS BIGINT) AS own
  FROM placed p JOIN nodes o ON o.tree = p.tree AND o.n > 1 AND o.idx // {FAN} = p.idx // CAST({FAN} ** (o.lvl + 1) AS BIGINT)
  UNION ALL SELECT p.tree, p.idx, d + o.lvl, o.h, o.idx, m.idx // CAST({FAN} ** o.lvl AS BIGINT)
  FROM placed p JOIN depth USING (tree) JOIN named m ON m.tree = p.tree
    JOIN tops o ON o.n > 1 AND o.idx // {FAN} = m.idx // CAST({FAN} ** (o.lvl + 1) AS BIGINT)),
steps AS (SELECT tree, leaf_at, lvl, coalesce(string_agg(h, '' ORDER BY place) FILTER (place < own), '') AS ahead,
    coalesce(string_agg(h, '' ORDER BY place) FILTER (place > own), '') AS behind FROM ups GROUP BY ALL),
proof AS (SELECT tree, leaf_at, string_agg(ahead || behind, '' ORDER BY lvl) AS joined, max(lvl) + 1 AS len FROM steps GROUP BY ALL),
fold AS (SELECT tree, idx, 0 AS lvl, coalesce(tampered, leaf) AS h FROM placed
  UNION ALL SELECT f.tree, f.idx, f.lvl + 1, sha256(ahead || f.h || behind)
    FROM fold f JOIN steps s ON s.tree = f.tree AND s.leaf_at = f.idx AND s.lvl = f.lvl)
SELECT doc_id, leaf, m.h AS subroot, r.h AS root, sha256(coalesce(joined, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN named m USING (tree) JOIN (SELECT h FROM tops WHERE n = 1) r ON true
  LEFT JOIN proof q ON q.tree = p.tree AND q.leaf_at = p.idx
  JOIN fold f ON f.tree = p.tree AND f.idx = p.idx AND f.lvl = coalesce(q.len, 0)
"""
