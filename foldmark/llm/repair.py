"""Repair of conversation structure: the cheapest edits to ``(s?(ua)+)?``, least audit first, by prefix doubling.

A conversation's rows are numbered and judged (blank, duplicate, truncated). A node is (rows read, what came last: nothing, system,
user, assistant); its arcs are edits with the letters D(elete), I(nsert), K(eep), R(erole) of the audit.

1. Cost DP from the end gives every node the cost of what is left; arcs that keep to it are optimal.
2. Nodes are ranked by the least audit of length 1, 2, 4, ... that optimal arcs spell from them: an audit of twice the length is the
   pair (own rank, rank of the node that the pointer reaches), and pointers double along. At each node the arc of least
   rank stays; letters of a node's arcs differ, so there is one.
3. The path is read off at all its steps at once: step t follows the doubled pointers of the bits of t.

Long conversations: rows are dealt in blocks of BLOCK rows. A block is a 4 x 4 table of costs from state to state; such tables
are multiplied (min, plus) over doubled distances by joins of block with block, which gives the cost beyond each block, and the
blocks' maps from state to state are composed the same way, which gives the state that each block starts with. So no task holds
more than blocks, however many rows a conversation has. Row numbers come from range offsets and copies
are found by grouping on their text, which aggregates map-side.

Rows: null role and text count as one space. A conversation's rows are ordered by turn (nulls first), role and text. Rows that repeat
are duplicates. A null conv_id is a conversation of its own. A role is judged by its first letter (s, u, a); other roles, and
empty ones, cannot be kept. Extra columns are ignored; an empty table gives an empty result. Texts of any length are judged whole.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import CRC_TABLE, crc_sql, stored, tidy

BLOCK = 2048
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
DELETE, INSERT, REROLE, OPEN_END = 4, 3, 3, 3  # costs; Keep costs nothing, an undeleted truncated row OPEN_END more
LETTERS = "DIKR"
FAR = 1 << 40  # cost of what cannot be

# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; a text may end in 0 and 3
_ENDS = np.array([0, FAR, FAR, 0])
_NEXT = np.array([2, 2, 3, 2])  # state after the user or assistant turn that is due
_TO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ROLES = {2: "user", 3: "assistant"}


def _arcs_of_rows():
    """Keep targets and costs, and Rerole costs, by row code (4 * fault + role letter) and state."""
    target, keep, rerole = np.zeros((16, 4), np.int64), np.full((16, 4), FAR), np.full((16, 4), FAR)
    for code in range(16):
        fault, letter = divmod(code, 4)
        if fault in (BLANK, DUPLICATE):
            continue
        more = OPEN_END * (fault == TRUNCATED)
        rerole[code] = REROLE + more
        for state in range(4):
            if (state, "sua "[letter]) in _TO:
                target[code, state], keep[code, state] = _TO[state, "sua "[letter]], more
    return target, keep, rerole


KEEP_TO, KEEP_COST, REROLE_COST = _arcs_of_rows()


class Blocks:
    """The nodes of several blocks in flat arrays: block by block, row by row, state by state.

    ``codes`` are the blocks' row codes; ``last`` says which blocks end their conversation.
    """

    def __init__(self, codes, last):
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.codes = np.concatenate([np.asarray(c, np.int64) for c in codes]) if len(codes) else np.zeros(0, np.int64)
        self.last = np.asarray(last, bool)
        self.rows = np.concatenate([[0], np.cumsum(self.sizes)])
        self.base = 4 * (self.rows[:-1] + np.arange(len(self.sizes)))  # first node of a block
        self.end = self.base + 4 * self.sizes  # first node behind its rows
        self.total = 4 * (len(self.codes) + len(self.sizes))

    def costs(self, beyond):
        """Cost of what is left from every node, with ``beyond`` (blocks x 4) behind the last row."""
        cost = np.full(self.total, FAR)
        four = np.arange(4)
        tail = np.array(beyond, np.int64)
        tail[self.last] = _with_inserts(tail[self.last])
        cost[self.end[:, None] + four] = tail
        order = np.argsort(-self.sizes, kind="stable")
        longest = -self.sizes[order]
        for t in range(int(self.sizes.max(initial=0))):
            now = order[:np.searchsorted(longest, -t)]  # blocks of more than t rows
            at = self.sizes[now] - 1 - t
            code, node = self.codes[self.rows[now] + at], self.base[now] + 4 * at
            after = cost[node[:, None] + 4 + four]
            best = np.minimum(DELETE + after, np.minimum(
                KEEP_COST[code] + np.take_along_axis(after, KEEP_TO[code], 1), REROLE_COST[code] + after[:, _NEXT]))
            cost[node[:, None] + four] = _with_inserts(best)
        return np.minimum(cost, FAR)

    def least_arcs(self, cost):
        """(letter, target) of each node's optimal arc of least letter; -1 and itself where a block is left."""
        node = np.arange(self.total)
        state, letter, target = node % 4, np.full(self.total, -1), node.copy()
        ends = np.zeros(self.total, bool)
        ends[(self.end[:, None] + np.arange(4)).ravel()] = True
        inner = node[~ends]
        code, s = np.repeat(self.codes, 4), state[~ends]

        def take(at, to, price, name):
            fits = cost[at] == price + cost[to]
            letter[at[fits]], target[at[fits]] = LETTERS.index(name), to[fits]

        below = inner - s + 4
        take(inner, below + _NEXT[s], REROLE_COST[code, s], "R")
        take(inner, below + KEEP_TO[code, s], KEEP_COST[code, s], "K")
        take(inner, inner - s + _NEXT[s], INSERT, "I")
        take(inner, below + s, DELETE, "D")
        close = (self.end[self.last][:, None] + np.array([1, 2])).ravel()
        take(close, close - close % 4 + _NEXT[close % 4], INSERT, "I")
        return letter, target


def _with_inserts(cost):
    """Costs of the four states when turns may be inserted first."""
    out = cost.copy()
    out[:, 2] = np.minimum(cost[:, 2], INSERT + cost[:, 3])
    out[:, 3] = np.minimum(cost[:, 3], INSERT + cost[:, 2])
    out[:, :2] = np.minimum(cost[:, :2], INSERT + out[:, 2:3])
    return out


def doubled(letter, target):
    """(ranks, pointers by power of two, steps to the end) of the nodes.

    The rank of a node orders its whole least audit among those of all nodes; round k knows
    audits of length 2**k.
    """
    rank, pointers, steps = letter + 1, [target], (letter >= 0).astype(np.int64)
    while True:
        reached = pointers[-1]
        if (letter[reached] < 0).all():
            return rank, pointers, steps
        pair = rank * (rank.max() + 1) + rank[reached]
        rank = np.unique(pair, return_inverse=True)[1]
        steps = steps + steps[reached]
        pointers.append(reached[reached])


def nodes_on_path(start, pointers, steps):
    """(owner, node) at every step of the least paths from ``start``."""
    length = steps[start]
    owner = np.repeat(np.arange(len(start)), length)
    node, t = start[owner], np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    for k, pointer in enumerate(pointers):
        use = (t >> k) & 1 == 1
        node[use] = pointer[node[use]]
    return owner, node


def _blocks_of(batch):
    """The blocks of a batch with columns conv, block, codes (own rows only), last, ..."""
    own = batch.column(2)
    flat, ends = own.flatten().to_numpy(), own.offsets.to_numpy() - own.offsets[0].as_py()
    return Blocks([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], batch.column(3).to_numpy(zero_copy_only=False))


def _tables(batches):
    """conv, block, 16 costs from state to state."""
    for batch in batches:
        blocks = _blocks_of(batch)
        n, columns = len(blocks.sizes), []
        for out in range(4):
            beyond = np.full((n, 4), FAR)
            beyond[:, out] = 0
            columns.append(blocks.costs(beyond)[blocks.base[:, None] + np.arange(4)])
        costs = np.stack(columns, axis=2).reshape(n, 16)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), _lists(costs)], ["conv", "block", "costs"])


def _lists(rows):
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _solved(batch):
    blocks = _blocks_of(batch)
    beyond = np.tile(_ENDS, (len(blocks.sizes), 1))
    known = batch.column(4)
    at = np.flatnonzero(~np.array(known.is_null()))
    if len(at):
        beyond[at] = known.drop_null().flatten().to_numpy().reshape(-1, 4)
    letter, target = blocks.least_arcs(blocks.costs(beyond))
    return (blocks, letter, target, *doubled(letter, target)[1:])


def _maps(batches):
    """conv, block, the state in which the least path from each state leaves the block."""
    for batch in batches:
        blocks, _, _, pointers, _ = _solved(batch)
        out = pointers[-1][blocks.base[:, None] + np.arange(4)] % 4
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(out)], ["conv", "block", "states"])


EDITS = "conv string, seq long, row long, edit string, cost long, new_role string"
_PRICES = np.array([DELETE, INSERT, 0, REROLE])  # of LETTERS


def _edits(batches):
    """One row per edit of the least path from the state in which each block starts."""
    for batch in batches:
        blocks, letter, target, pointers, steps = _solved(batch)
        first = batch.column(1).to_numpy() * BLOCK
        owner, node = nodes_on_path(blocks.base + batch.column(5).to_numpy(), pointers, steps)
        edit = letter[node]
        ahead = (node - blocks.base[owner]) // 4  # rows of the block already read
        count = np.bincount(owner, minlength=len(first))
        seq = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)  # at most 5 edits for the last row, 3 for others
        own = edit != LETTERS.index("I")
        code = np.zeros(len(node), np.int64)
        code[own] = blocks.codes[(blocks.rows[:-1][owner] + ahead)[own]]
        cost = _PRICES[edit] + OPEN_END * ((code // 4 == TRUNCATED) & (edit != LETTERS.index("D")))
        names = np.array(["", "", "user", "assistant"], object)[target[node] % 4]
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(owner)), pa.array(8 * first[owner] + seq),
            pa.array(first[owner] + ahead, pa.int64(), mask=~own),
            pa.array(np.array(list(LETTERS), object)[edit]),
            pa.array(cost, pa.int64()),
            pa.array(names, pa.string(), mask=~np.isin(edit, [LETTERS.index("I"), LETTERS.index("R")])),
        ], [c.split()[0] for c in EDITS.split(", ")])


def judged(conversations):
    """(lines, faults): numbered rows with text; conv, row, role letter, fault and turn of each without it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    lines = numbered(conversations.select(key, "turn", text("role"), text("text")), ["turn", "role", "text"], ["conv"], "row")
    body = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    marks = stored(lines.select(
        "conv", "row", "turn", F.expr("locate(substring(role, 1, 1), 'sua')").alias("at"), F.length("role").alias("named"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("mark"),
        (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open")), "repair-marks")
    first = marks.groupBy("conv", "mark").agg(F.min("row").alias("row")).select("conv", "row", F.lit(True).alias("first"))
    letter = F.when((F.col("at") > 0) & (F.col("named") > 0), F.col("at") - 1).otherwise(3)
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(0)
    faults = marks.join(first, ["conv", "row"], "left").select("conv", "row", "turn", letter.alias("letter"), fault.alias("fault"))
    return lines, stored(faults, "repair-faults")


def _block_table(faults):
    """conv, block, codes of its rows, whether it is the last, and illegal neighbours up to the next block's first row."""
    block = F.floor(F.col("row") / BLOCK).cast("long")
    also = F.when((F.col("row") % BLOCK == 0) & (F.col("row") > 0), F.array(block, block - 1)).otherwise(F.array(block))
    rows = (faults.select("conv", F.explode(also).alias("block"), "row", (4 * F.col("fault") + F.col("letter")).alias("code"))
            .groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("row", "code"))).alias("rows")))
    pair = lambda k: 4 * (F.col("all")[k] % 4) + F.col("all")[k + 1] % 4
    wrong = F.size(F.filter(F.sequence(F.lit(0), F.size("all") - 2), lambda k: ~pair(k).isin(1, 6, 9)))  # su, ua, au
    mine = F.filter("rows", lambda r: F.floor(r["row"] / BLOCK) == F.col("block"))
    return (rows.select("conv", "block", F.col("rows.code").alias("all"), F.transform(mine, lambda r: r["code"]).alias("codes"))
            .select("conv", "block", "codes", (F.size("all") == F.size("codes")).alias("last"),
                    F.when(F.size("all") > 1, wrong).otherwise(0).alias("illegal")))


def _times(a, b):
    """(min, plus) product of two tables of 4 x 4 costs."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: F.array_min(F.array(*[
        a[(F.floor(x / 4) * 4 + k).cast("int")] + b[(4 * k + x % 4).cast("int")] for k in range(4)])))


def _over_blocks(rows, value, combine, step):
    """``value`` of each block combined with those of all later (step 1) or earlier (-1) blocks of its conversation."""
    reach, top = 1, rows.agg(F.max("block")).first()[0]
    while reach <= top:
        other = rows.select("conv", (F.col("block") - step * reach).alias("block"), F.col(value).alias("other"))
        met = rows.join(other, ["conv", "block"], "left")
        joined = F.when(F.col("other").isNull(), F.col(value)).otherwise(combine(F.col(value), F.col("other")))
        rows = stored(met.select("conv", "block", joined.alias(value)), "repair-reach")
        reach *= 2
    return rows


def _with_borders(blocks):
    """``blocks`` with the costs beyond each block and the state in which it starts."""
    whole = blocks.where("block = 0 AND last").select(
        "conv", "block", "codes", "last", F.lit(None).cast("array<bigint>").alias("beyond"), F.lit(0).cast("long").alias("entry"))
    parts = blocks.where("block > 0 OR NOT last").select("conv", "block", "codes", "last")
    if parts.isEmpty():
        return whole
    tables = stored(parts.mapInArrow(tidy(_tables), "conv string, block long, costs array<long>"), "repair-tables")
    tails = _over_blocks(tables, "costs", _times, 1)
    # behind the last row of a conversation only inserts are left, which the last block's table does not hold
    final = [int(c) for c in _with_inserts(_ENDS[None])[0]]
    left = F.array(*[F.array_min(F.array(*[F.col("costs")[4 * s + e] + final[e] for e in range(4)])) for s in range(4)])
    beyond = tails.select("conv", (F.col("block") - 1).alias("block"), left.alias("beyond"))
    parts = stored(parts.join(beyond, ["conv", "block"], "left"), "repair-parts")
    maps = stored(parts.mapInArrow(tidy(_maps), "conv string, block long, states array<long>"), "repair-maps")
    heads = _over_blocks(maps, "states", lambda own, before: F.transform(before, lambda s: own[s.cast("int")]), -1)
    entry = heads.select("conv", (F.col("block") + 1).alias("block"), F.col("states")[0].alias("entry"))
    parts = parts.join(entry, ["conv", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(0).cast("long")))
    return whole.unionByName(parts)


def repaired(conversations):
    """(edits, faults, blocks) of all conversations.

    ``edits`` has a row per edit: conv (the id as text behind "=", empty for null), seq (its order), edit (letter), cost, turn, role and
    text after the edit (a deleted row's own).
    """
    lines, faults = judged(conversations)
    blocks = stored(_block_table(faults), "repair-blocks")
    edits = _with_borders(blocks).mapInArrow(tidy(_edits), EDITS)
    table = edits.join(lines, ["conv", "row"], "left").select(
        "conv", "seq", "edit", "cost", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return table, faults, blocks


DIGESTS = "conv string, cost long, audit string, repaired_sha256 string"


def _digested(batches):
    """Cost, audit and hash of each conversation from its edits in order; a conversation streams by.

    Conversations that end in a batch leave together: a batch of one row each costs far more than its hash.
    """
    now, sha, cost, audit, any_row, out = None, None, 0, [], False, []
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def done():
        kinds = pa.string(), pa.int64(), pa.string(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for conv, edit, price, role, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if conv != now:
                if now is not None:
                    out.append((now, cost, "".join(audit), sha.hexdigest()))
                now, sha, cost, audit, any_row = conv, hashlib.sha256(), 0, [], False
            cost += price
            audit.append(edit)
            if edit != "D":
                sha.update(f"{chr(10) * any_row}{role}:{text}".encode("utf-8", "surrogatepass"))
                any_row = True
        if out:
            yield done()
            out = []
    if now is not None:
        out.append((now, cost, "".join(audit), sha.hexdigest()))
        yield done()


def digests(edits):
    """conv, cost, audit and repaired_sha256 per conversation with edits."""
    order = edits.select("conv", "edit", "cost", "role", "text", "seq").repartition("conv").sortWithinPartitions("conv", "seq")
    return order.select("conv", "edit", "cost", "role", "text").mapInArrow(tidy(_digested), DIGESTS)


def damaged(conversations):
    """``conversations`` (conv_id, turn, role, text) with a fifth of the rows spoilt by the hash of their id and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    spoilt = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(text("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return (conversations.select("conv_id", "turn", role.alias("role"), spoilt.alias("text"), times.alias("times"))
            .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times", "copy"))


def report(original, conversations):
    """One row per conv_id of ``original`` on the repair of ``conversations``: the counts, cost, audit and hash."""
    edits, faults, blocks = repaired(conversations)
    count = lambda k: F.count_if(F.col("fault") == k)
    counts = faults.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"))
    illegal = blocks.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    ids = original.select("conv_id").distinct().withColumn(
        "conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    out = ids
    for part in (counts, illegal, digests(edits)):
        out = out.join(part, "conv", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: A recursion from the last row to the first over whole audits; per state (0 to 3) the least (cost, audit).
ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations, crc_table),
spoilt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds)),
placed AS (SELECT *, coalesce(conv_id::VARCHAR, 'null') AS conv, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    lag(role) OVER w AS before FROM spoilt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
faults AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare FROM placed)),
ends AS (SELECT DISTINCT conv, n + 1 AS i, [{{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS best FROM faults),
walk AS (SELECT conv, i, best FROM ends
  UNION ALL
  SELECT conv, i, [list_aggregate([o[1], {{'c': 3 + o[3].c, 'a': 'I' || o[3].a}}], 'min'),
      list_aggregate([o[2], {{'c': 3 + o[3].c, 'a': 'I' || o[3].a}}], 'min'),
      list_aggregate([o[3], {{'c': 3 + o[4].c, 'a': 'I' || o[4].a}}], 'min'),
      list_aggregate([o[4], {{'c': 3 + o[3].c, 'a': 'I' || o[3].a}}], 'min')]
  FROM (SELECT f.conv, f.i, list_transform([1, 2, 3, 4], lambda s: list_aggregate([
        {{'c': 4 + best[s].c, 'a': 'D' || best[s].a}},
        CASE WHEN fault IN (0, 3) THEN {{'c': fault + 3 + best[[3, 3, 4, 3][s]].c, 'a': 'R' || best[[3, 3, 4, 3][s]].a}} END,
        CASE WHEN fault IN (0, 3) AND left(role, 1) = ['u', 'u', 'a', 'u'][s]
          THEN {{'c': fault + best[[3, 3, 4, 3][s]].c, 'a': 'K' || best[[3, 3, 4, 3][s]].a}} END,
        CASE WHEN fault IN (0, 3) AND left(role, 1) = 's' AND s = 1 THEN {{'c': fault + best[2].c, 'a': 'K' || best[2].a}} END], 'min')) AS o
    FROM walk w JOIN faults f ON f.conv = w.conv AND f.i = w.i - 1)),
audits AS (SELECT conv, best[1].c AS cost, best[1].a AS audit FROM walk WHERE i = 1),
letters AS (SELECT conv, k, audit[k] AS e, len(regexp_replace(audit[:k], 'I', '', 'g')) AS i FROM (
    SELECT conv, audit, unnest(range(1, len(audit) + 1)) AS k FROM audits)),
emitted AS (SELECT l.conv, k, e, role, text, row_number() OVER (PARTITION BY l.conv ORDER BY k)
      - max(CASE WHEN e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv) AS place
  FROM letters l LEFT JOIN faults f ON e <> 'I' AND f.conv = l.conv AND f.i = l.i WHERE e <> 'D'),
hashes AS (SELECT conv, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    coalesce(text, ''), chr(10) ORDER BY k)) AS h FROM emitted GROUP BY conv),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'null') AS conv FROM conversations)
  LEFT JOIN counts USING (conv) LEFT JOIN audits USING (conv) LEFT JOIN hashes USING (conv)
"""
