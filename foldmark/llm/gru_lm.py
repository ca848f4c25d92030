"""Gated recurrent language model over words, with a class-factored output, written in numpy.

Tokens: words between the seven ASCII white-space characters, A-Z lower-cased, then one end
token a document. Every token has a class, neighbouring classes form groups, and the network predicts

    P(token | before) = P(group | state) * P(class | group, state) * P(token | class[, state])

The most frequent training tokens share head classes by frequency, and the
network predicts them within their class, too. Their number follows the counts: HEAD, or four times as many again and
again while all of them occur SEEN times, up to MOST_HEAD (a replica's parameters have to fit a task); for
2 k k words there are k classes, cut so that each holds the same sum of square roots of counts: frequent words share small classes,
rare ones large classes, which are seldom worked out, as only the target's group and class are (k classes in all make
about sqrt(k) groups). All other words belong to TAIL classes by their
spelling (a hash of the last two bytes), so that a word never seen has one as well; within a tail class a word
has its training count, less DISCOUNT, over the class's count, and what the
discounts set free belongs to unseen words together. The state starts at zero and is carried
through all windows of a document, which is scored whole.

Training sees every training document once: after a warm start on a bounded sample
(WARM_DOCS documents, of which those that begin within WARM_TOKENS are used, so that all replicas start in one basin) each replica trains over
all documents of some partitions, together about PIECE tokens or more, by truncated backpropagation (WINDOW steps, state carried
on; the last lane is filled up with masked places, so that no token is left out), and the replicas are averaged by their numbers of tokens,
summed by Spark per block of parameters.
Word counts are taken over all training documents and joined to the words of all documents;
only the common words and the tail classes' totals are handed to the tasks.

Rows: null text counts as empty and has the end token only. A row without doc_id is in no fold:
it trains and is not held out. Repeated rows count, train and are scored each. Extra columns
are ignored; an empty table gives an empty result. Where there is no training
token all counts are 0 and the model is its start.
"""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import fold, lists, raw_texts, stored, tidy

HEAD, TAIL = 512, 48
MOST_HEAD, SEEN = 1 << 15, 8
COMMON = 1 << 18  # words whose counts every task holds
HIDDEN, WINDOW = 16, 20
DISCOUNT = 0.75
WARM_DOCS, WARM_TOKENS, WARM_ROUNDS, WARM_LANES, LANES = 1500, 600_000, 3, 96, 1536
WARM_STEPS = 300  # updates of the warm start, however small the sample, unless held-back documents get less likely
UPDATES = 150  # least updates that a replica aims at; few tokens get fewer lanes
RATE = 0.006
NONE = -1  # a place without a token
END = b""  # no word is empty
PIECE, BLOCK, TOGETHER = 4_000_000, 16_384, 64  # tokens trained at once, values a row, replicas added at once
ROWS, CELLS = 65_536, 1 << 17  # tokens scored at once, and cells of a softmax worked out at once
FAR, OFTEN = 60, 24  # logits that exp can bear with room to spare; rows of a token that are added one by one
TEXT = 1 << 23  # bytes of text that are cut into words at once
SCORED_TOGETHER, STEPS = 2048, 256  # documents scored side by side, and the most steps before their softmaxes
_FLUSH = 250_000


def head_size(counts):
    """Number of words the network predicts one by one, from the counts of the common words, largest first."""
    head = HEAD
    while 4 * head <= min(MOST_HEAD, len(counts)) and counts[4 * head - 1] >= SEEN:
        head *= 4
    return head


def class_bounds(counts, head):
    """First word of each head class and the end, for ``head`` words of the given counts (places without a word count once)."""
    classes = math.isqrt(head // 2)
    mass = np.ones(head)
    mass[:min(head, len(counts))] = np.sqrt(np.maximum(counts[:head], 1))
    share = np.cumsum(mass)
    cuts = np.searchsorted(share, share[-1] * np.arange(1, classes) / classes)
    least = np.arange(1, classes)  # every class holds a word
    return np.concatenate([[0], np.minimum(np.maximum.accumulate(np.maximum(cuts - least, 0)) + least, head - classes + least), [head]])


def tail_class(word):
    """Class of a word outside the head, from its last two bytes."""
    return zlib.crc32(word[-2:]) % TAIL


class Words:
    """Numbers of words: a word's place among the common words, or after them its tail class."""

    def __init__(self, table):
        self.known, self.common = pa.array(table.words, pa.binary()), len(table.words)
        self.end = table.words.index(END) if END in table.words else self.common + tail_class(END)

    def of(self, column):
        """``numbers`` of the rows of a text column, some at a time."""
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // TEXT, prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield self.numbers(column.slice(a, b - a))

    def numbers(self, column):
        """(numbers of each row's words and its end, those of them that are not common row by row)."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
        ends, words = words.offsets.to_numpy(), words.flatten().cast(pa.binary())
        real = pc.binary_length(words).to_numpy() > 0  # white space at an end of the text leaves an empty word
        n = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().copy()
        other = np.flatnonzero((n < 0) & real)
        others = words.take(pa.array(other)).to_pylist()
        n[other] = np.fromiter(map(tail_class, others), np.int32, len(others)) + self.common
        ends_real = np.concatenate([[0], np.cumsum(real)])[ends[1:]]
        n = np.insert(n[real], ends_real, self.end)
        cuts = np.searchsorted(other, ends)
        last = [END] if self.end >= self.common else []
        return (np.split(n, ends_real[:-1] + np.arange(1, len(column))),
                [others[a:b] + last for a, b in zip(cuts, cuts[1:], strict=False)])


class Table:
    """The common words, most frequent first, and what a task needs to know of their counts."""

    def __init__(self, words, counts, tail_tokens, tail_words):
        self.words, self.head = words, head_size(counts)
        n = np.array(counts, np.float64)
        self.bounds = class_bounds(n, self.head)
        tail = np.array([tail_class(w) for w in words], np.int64)
        k = np.arange(len(words))
        self.code = np.concatenate([np.where(k < self.head, k, self.head + tail), self.head + np.arange(TAIL)]).astype(np.int32)
        self.base = np.concatenate([np.log10(n + 1), np.zeros(TAIL)])
        self.level = np.log10(np.maximum(tail_tokens, 1))  # of a tail class
        own = np.log10(np.maximum(n - DISCOUNT, 1e-9)) - self.level[tail]
        self.tail = np.concatenate([np.where(k < self.head, 0, own), np.zeros(TAIL)])
        # share of unseen words in their class; a class without training words leaves them everything
        free = np.where(tail_words > 0, DISCOUNT * tail_words, 1)
        self.unseen = np.log10(free) - self.level


def _order(codes):
    """Places of ``codes`` in ascending order, NONE last; short numbers are sorted by their digits."""
    return np.argsort(codes.astype(np.uint16 if codes.max(initial=0) < (1 << 16) - 1 else np.uint32), kind="stable")


def _with_one(states):
    return np.concatenate([states, np.ones((len(states), 1), np.float32)], axis=1)


def _row_sums(values, keys):
    """(distinct keys, sum of the rows of each): the k-th rows of all keys at a time, those of frequent keys key by key."""
    by = _order(keys)
    starts = np.flatnonzero(np.diff(keys[by], prepend=-1))
    many = np.diff(starts, append=len(by))
    most = np.argsort(-many, kind="stable")
    starts, many = starts[most], many[most]
    sums = values[by[starts]]
    often = int(np.count_nonzero(many > OFTEN))
    for k in range(often):
        sums[k] = values[by[starts[k]:starts[k] + many[k]]].sum(axis=0)
    for k in range(1, OFTEN):
        some = int(np.count_nonzero(many > k))
        sums[often:some] += values[by[starts[often:some] + k]]
    return keys[by[starts]], sums


def _shifted(x, plain):
    """``x`` for exp, in place: as it is where no row can overflow or vanish, else less its rows' greatest values."""
    if not plain:
        x -= x.max(axis=1, keepdims=True)
    return x


def _misses(x, place, scale, plain):
    """Softmax of each row less 1 at its place, times ``scale``: the gradient of the mean log loss. Works in ``x``."""
    np.exp(_shifted(x, plain), out=x)
    x *= (scale / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
    x[np.arange(len(place)), place] -= scale
    return x


def _log_at(x, place, plain):
    """Logarithm of one softmax cell of each row. Works in ``x``."""
    at = _shifted(x, plain)[np.arange(len(place)), place]
    np.exp(x, out=x)
    return at - np.log(x @ np.ones(x.shape[1], x.dtype))


class Net:
    """Parameters as one flat vector, so that replicas can be averaged."""

    def __init__(self, seed=3, head=HEAD, bounds=None):
        self.head = head
        self.bounds = class_bounds(np.zeros(0), head) if bounds is None else bounds
        self.classes = len(self.bounds) - 1
        self.groups = np.linspace(0, self.classes + TAIL, math.isqrt(self.classes + TAIL) + 1).astype(np.int64)
        self.of_code = np.concatenate([np.repeat(np.arange(self.classes), np.diff(self.bounds)), self.classes + np.arange(TAIL)])
        self.group_of = np.repeat(np.arange(len(self.groups) - 1), np.diff(self.groups))
        # what each softmax chooses from: first places of its pieces, and the end
        self.pieces = {"grp": np.array([0, len(self.groups) - 1]), "cls": self.groups, "word": self.bounds}
        h = HIDDEN
        # the last column of an output is its bias, which meets a state's last place, a one
        self.shapes = {"emb": (head + TAIL + 1, 3 * h), "rec": (h, 3 * h)} | {k: (int(b[-1]), h + 1) for k, b in self.pieces.items()}
        rng = np.random.default_rng(seed)
        self.flat = np.concatenate([rng.normal(0, 0.3 / h ** 0.5, s).astype(np.float32).ravel() for s in self.shapes.values()])
        self.p = self.views(self.flat)
        for k in self.pieces:
            self.p[k][:, -1] = 0

    def views(self, flat):
        """The parameters, or other values laid out like all or the last of them, by name."""
        end, out = len(flat), {}
        for k, s in reversed(self.shapes.items()):
            start = end - int(np.prod(s))
            if start >= 0:
                out[k] = flat[start:end].reshape(s)
            end = start
        return out

    def start(self, table, counts):
        """Output biases from the training counts."""
        n = np.array(counts[:self.head], np.float64)
        grp, cls, word = (self.p[k][:, -1] for k in self.pieces)
        word[:] = -20  # places without a word
        word[:len(n)] = np.log(n)
        heads = np.bincount(self.of_code[:len(n)], n, self.classes)
        tokens = np.concatenate([heads, 10.0 ** table.level])
        cls[:] = np.log(tokens + 1)
        grp[:] = np.log(np.add.reduceat(tokens, self.groups[:-1]) + 1)
        for k, bounds in self.pieces.items():
            bias = self.p[k][:, -1]
            bias -= np.repeat(np.maximum.reduceat(bias, bounds[:-1]), np.diff(bounds))

    def step(self, h, x):
        """One step of the gated unit; x holds the rows of ``emb`` of the tokens before. Quickest where both lie column by column."""
        h, x, rec = h.T, x.T, self.p["rec"].T
        zr = rec[:2 * HIDDEN] @ h
        zr += x[:2 * HIDDEN]
        np.exp(np.negative(zr, out=zr), out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        c = rec[2 * HIDDEN:] @ (r * h)
        c += x[2 * HIDDEN:]
        np.tanh(c, out=c)
        new = c - h
        new *= z
        new += h
        return new.T, z.T, r.T, c.T

    def inputs(self, before):
        """Rows of ``emb`` laid out for ``step``."""
        return np.asfortranarray(self.p["emb"][before])

    def plain(self):
        """Whether exp of no logit can overflow and every softmax keeps its largest: states lie between -1 and 1."""
        for k, bounds in self.pieces.items():
            bias, wide = self.p[k][:, -1], np.abs(self.p[k][:, :-1]).sum(axis=1)
            if (bias + wide).max() > FAR or np.maximum.reduceat(bias - wide, bounds[:-1]).min() < -FAR:
                return False
        return True

    def choices(self, codes):
        """(output, its places to choose from, rows that do, the places they choose) for all softmaxes of the sorted ``codes``."""
        cls = self.of_code[codes]
        for (k, bounds), own in zip(self.pieces.items(), (self.group_of[cls], cls, codes), strict=True):
            cuts = np.searchsorted(own, bounds)
            for c in np.flatnonzero(np.diff(cuts)):
                a, b, end = int(bounds[c]), int(bounds[c + 1]), int(cuts[c + 1])
                step = max(64, CELLS // (b - a))  # pieces that stay in a core's cache
                for at in range(int(cuts[c]), end, step):
                    rows = slice(at, min(at + step, end))
                    yield k, slice(a, b), rows, own[rows] - a

    def log_p(self, states, codes, plain=None):
        """Natural log of P(group) P(class | group) and, for head tokens, P(token | class)."""
        plain = self.plain() if plain is None else plain
        if len(codes) > ROWS:
            return np.concatenate([self.log_p(states[a:a + ROWS], codes[a:a + ROWS], plain) for a in range(0, len(codes), ROWS)])
        order = _order(codes)
        codes, states = codes[order], _with_one(states[order])
        out = np.zeros(len(codes), np.float32)
        for k, places, rows, chosen in self.choices(codes):
            out[rows] += _log_at(states[rows] @ self.p[k][places].T, chosen, plain)
        back = np.empty_like(out)
        back[order] = out
        return back

    def score(self, texts):
        """Log probability of each document: rows sorted by length, the state carried from window to window."""
        total, plain = np.zeros(len(texts)), self.plain()
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for a in range(0, len(order), SCORED_TOGETHER):
            some = order[a:a + SCORED_TOGETHER]
            total[some] = self._score([texts[k] for k in some], plain)
        return total

    def _score(self, texts, plain):
        lengths = np.array([len(t) for t in texts])  # longest first
        starts = np.cumsum(lengths) - lengths
        stream = np.concatenate([*texts, np.zeros(STEPS, np.int32)])
        total = np.zeros(len(texts))
        h = np.zeros((HIDDEN, len(texts)), np.float32).T
        before = np.full(len(texts), self.head + TAIL, np.int32)
        at = 0
        while at < lengths[0]:
            live = int(np.searchsorted(-lengths, -at, side="left"))
            here = np.minimum(lengths[:live] - at, max(16, min(STEPS, ROWS // live)))
            steps = int(here[0])
            block = stream[starts[:live] + np.arange(at, at + steps)[:, None]]
            there = np.arange(steps)[:, None] < here
            counts = there.sum(axis=1)
            states = np.empty((int(counts.sum()), HIDDEN), np.float32)
            pos = 0
            for t, n in enumerate(counts):
                h = self.step(h[:n], self.inputs(before[:n]))[0]
                states[pos:pos + n] = h
                before = block[t]
                pos += n
            total[:live] += np.bincount(np.nonzero(there)[1], self.log_p(states, block[there], plain), live)
            at += steps
        return total

    def train(self, texts, lanes, rate=RATE):
        """One pass of truncated backpropagation over ``texts``, joined to ``lanes`` streams."""
        total = sum(map(len, texts))
        lanes = max(1, min(lanes, len(texts), total // (WINDOW * UPDATES)))
        if not total:
            return
        n = -(-total // lanes)
        stream = np.full(n * lanes, NONE, np.int32)
        stream[:total] = np.concatenate(texts)
        fresh = np.zeros(n * lanes, bool)
        fresh[np.cumsum([0] + [len(t) for t in texts[:-1]])] = True
        codes = np.ascontiguousarray(stream.reshape(lanes, n).T)
        fresh = fresh.reshape(lanes, n).T.copy()
        fresh[0] = True
        prev = np.vstack([np.full((1, lanes), self.head + TAIL, np.int32), codes[:-1]])
        prev = np.where(fresh | (prev == NONE), self.head + TAIL, prev)
        h = np.zeros((lanes, HIDDEN), np.float32)
        if not hasattr(self, "m1"):
            self.m1, self.m2, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        for at in range(0, n, WINDOW):
            h = self._window(h, prev[at:at + WINDOW], codes[at:at + WINDOW], fresh[at:at + WINDOW], rate)

    def warm(self, texts):
        """Passes over a sample until a tenth that is held back gets less likely, or steps and rounds are made."""
        back, texts = texts[::10], [t for k, t in enumerate(texts) if k % 10] or texts
        best, flat, rounds = -np.inf, self.flat.copy(), 0
        while rounds < WARM_ROUNDS or self.t < WARM_STEPS:
            self.train(texts, WARM_LANES)
            rounds += 1
            likely = self.score(back).sum()
            if likely < best or not hasattr(self, "t"):
                break
            best, flat = likely, self.flat.copy()
        self.flat[:] = flat

    def _window(self, h, prev, codes, fresh, rate):
        p, (steps, lanes) = self.p, codes.shape
        trail, every = [], np.empty((steps, lanes, HIDDEN), np.float32)
        for t in range(steps):
            if fresh[t].any():
                h = np.where(fresh[t], np.float32(0), h.T).T
            new, z, r, c = self.step(h, self.inputs(prev[t]))
            trail.append((h.T, z.T, r.T, c.T))
            every[t] = h = new
        last = h
        flat_codes = codes.ravel()
        order = _order(flat_codes)[:np.count_nonzero(flat_codes != NONE)]
        flat_codes = flat_codes[order]
        states = _with_one(every.reshape(-1, HIDDEN)[order])
        if self.t % WINDOW == 0:  # some updates move no logit far
            self.fits = self.plain()
        n = p["emb"].size
        flat = np.zeros(len(self.flat) - n, np.float32)
        grad = self.views(flat)
        rec = grad["rec"]
        scale = np.float32(1 / max(1, len(flat_codes)))
        back = np.zeros((len(states), HIDDEN), np.float32)
        for k, places, rows, chosen in self.choices(flat_codes):
            own, mine = states[rows], p[k][places]
            e = _misses(own @ mine.T, chosen, scale, self.fits)
            grad[k][places] += e.T @ own
            back[rows] += e @ mine[:, :-1]
        every[:] = 0
        every.reshape(-1, HIDDEN)[order] = back
        carry, inputs = np.zeros((HIDDEN, lanes), np.float32), np.empty((steps, lanes, 3 * HIDDEN), np.float32)
        gates = np.empty((3 * HIDDEN, lanes), np.float32)
        dz, dr, da = gates[:HIDDEN], gates[HIDDEN:2 * HIDDEN], gates[2 * HIDDEN:]
        for t in range(steps - 1, -1, -1):
            h, z, r, c = trail[t]
            dh = every[t].T + carry
            np.multiply(dh * z, 1 - c * c, out=da)
            drh = p["rec"][:, 2 * HIDDEN:] @ da
            np.multiply(dh * (c - h), z * (1 - z), out=dz)
            np.multiply(drh * h, r * (1 - r), out=dr)
            rec[:, :2 * HIDDEN] += h @ gates[:2 * HIDDEN].T
            rec[:, 2 * HIDDEN:] += (r * h) @ da.T
            carry = dh * (1 - z) + drh * r + p["rec"][:, :2 * HIDDEN] @ gates[:2 * HIDDEN]
            carry[:, fresh[t]] = 0
            inputs[t] = gates.T
        rows, rows_grad = _row_sums(inputs.reshape(-1, 3 * HIDDEN), prev.ravel())
        self.t += 1
        clip = np.float32(min(1, 1 / max(math.sqrt(float(flat @ flat) + float(np.vdot(rows_grad, rows_grad))), 1e-9)))
        # embeddings are a leading block of the parameters; only the rows in use move
        for a in range(0, len(flat), BLOCK):
            at = slice(n + a, n + min(a + BLOCK, len(flat)))
            self._move((self.flat, self.m1, self.m2), at, flat[a:a + BLOCK] * clip, rate)
        of, step = [x[:n].reshape(p["emb"].shape) for x in (self.flat, self.m1, self.m2)], BLOCK // (3 * HIDDEN)
        for a in range(0, len(rows), step):
            self._move(of, rows[a:a + step], rows_grad[a:a + step] * clip, rate)
        return last

    def _move(self, of, at, g, rate):
        """One step of Adam for some parameters: ``of`` holds them and their two moments."""
        value, first, second = of
        m1, m2 = first[at], second[at]
        m1 += np.float32(0.1) * (g - m1)
        g *= g
        g -= m2
        g *= np.float32(0.01)
        m2 += g
        first[at], second[at] = m1, m2
        root = np.sqrt(m2 * np.float32(1 / (1 - 0.99 ** self.t)))
        root += np.float32(1e-6)
        np.divide(m1, root, out=root)
        root *= np.float32(rate / (1 - 0.9 ** self.t))
        value[at] -= root


def word_counts(texts):
    """(word, n) over a text column, added up within a task first."""
    def count(batches):
        seen = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())],
                                              ["word", "n"])
        for batch in batches:
            for text in raw_texts(batch.column(0)):
                seen.update(text.lower().split())
                seen[END] += 1
            if len(seen) > _FLUSH:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return texts.mapInArrow(tidy(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _replica(table, start):
    """Trains one replica over the documents of a task; its parameters go out in blocks weighted by tokens in PIECEs."""
    def train(batches):
        numbers, net, kept, size, total = Words(table.value), Net(head=table.value.head, bounds=table.value.bounds), [], 0, 0
        net.flat[:] = start.value
        code = table.value.code
        for batch in batches:
            for rows, _ in numbers.of(batch.column(0)):
                for n in rows:
                    kept.append(code[n])
                    size += len(n)
                    if size > PIECE:
                        net.train(kept, LANES)
                        total, kept, size = total + size, [], 0
        if kept:
            net.train(kept, LANES)
            total += size
        if total:
            values = net.flat * np.float32(total / PIECE)
            for b, a in enumerate(range(0, len(values), BLOCK)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([b], pa.int32()),
                     pa.array([total], pa.int64()), pa.array([values[a:a + BLOCK].tobytes()], pa.binary())],
                    ["replica", "block", "tokens", "part"])

    return train


def _added(rows):
    """Sum of some replicas of one block."""
    total = np.sum([np.frombuffer(x, np.float32) for x in rows["part"].to_pylist()], axis=0, dtype=np.float64).astype(np.float32)
    return pa.table({"replica": pa.array([min(rows["replica"].to_pylist()) // TOGETHER], pa.int64()),
                     "block": rows["block"][:1], "tokens": pa.array([sum(rows["tokens"].to_pylist())], pa.int64()),
                     "part": pa.array([total.tobytes()], pa.binary())})


def _averaged(parts, replicas, start):
    """Token-weighted mean of all replicas: groups of TOGETHER are added until one is left."""
    while True:
        group = F.floor(F.col("replica") / TOGETHER).cast("long").alias("group")
        parts = (parts.withColumn("group", group).groupBy("group", "block")
                 .applyInArrow(_added, "replica long, block int, tokens long, part binary"))
        if replicas <= TOGETHER:
            break
        replicas = -(-replicas // TOGETHER)
    got = parts.orderBy("block").toArrow().to_pydict()
    if not got["block"]:
        return start
    flat = np.concatenate([np.frombuffer(x, np.float32) for x in got["part"]]) / (got["tokens"][0] / PIECE)
    return flat.astype(np.float32)


SCORED = ("row long, doc_id long, held_out boolean, n_tokens long, n_common long, base double, score double, "
          "rare array<binary>, times array<int>")


def _scored(table, flat):
    """Per row what its common words and the network say, and its other words with their numbers."""
    def run(batches):
        numbers, net, t = Words(table.value), Net(head=table.value.head, bounds=table.value.bounds), table.value
        net.flat[:] = flat.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                codes, base, score, sizes, known, words, own, times = [], [], [], [], [], [], [], []
                for rows, others in numbers.of(part.column(2)):
                    for n, rare in zip(rows, others, strict=True):
                        codes.append(t.code[n])
                        base.append(t.base[n].sum())
                        score.append(t.tail[n].sum())
                        sizes.append(len(n))
                        known.append(len(n) - len(rare))
                        rare = Counter(rare)
                        words += rare.keys()
                        times += rare.values()
                        own.append(len(rare))
                score = np.array(score) + net.score(codes) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(codes))), part.column(0), part.column(1), pa.array(sizes, pa.int64()),
                     pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                     lists(words, own, pa.binary()), lists(times, own, pa.int32())],
                    ["row", "doc_id", "held_out", "n_tokens", "n_common", "base", "score", "rare", "times"])
                row += len(codes)

    return run


def score(docs, common=COMMON):
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held = fold("doc_id", 7) == 2
    docs = docs.select("doc_id", held.alias("held_out"), "text")
    training = docs.where("NOT held_out").select("doc_id", "text")
    counts = stored(word_counts(training.select("text")), "lm-counts")
    tail = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(TAIL)).cast("int")
    # the common words: those above the count at which no more than ``common`` are left
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toArrow().to_pydict()
    room = int(np.searchsorted(np.cumsum(steps["words"]), common, side="right"))
    least = steps["n"][room - 1] if room else 1 << 62
    got = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").toArrow()
    words, n = got["word"].to_pylist(), got["n"].to_pylist()
    sums = (counts.groupBy(tail.alias("tail")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
            .toArrow().to_pydict())
    tail_tokens, tail_words = np.zeros(TAIL), np.zeros(TAIL)
    tail_tokens[sums["tail"]], tail_words[sums["tail"]] = sums["n"], sums["words"]
    top = head_size(n)
    of_head = np.array([tail_class(w) for w in words[:top]], np.int64)
    tail_tokens -= np.bincount(of_head, n[:top], TAIL)
    tail_words -= np.bincount(of_head, minlength=TAIL)
    total = int(sum(a * b for a, b in zip(steps["n"], steps["words"], strict=True)))
    distinct = int(sum(steps["words"]))
    table = Table(words, n, tail_tokens, tail_words)
    net = Net(head=table.head, bounds=table.bounds)
    n_docs = n[words.index(END)] if END in words else 0
    if n_docs:
        mark = F.pmod(F.xxhash64("doc_id", F.lit("warm")), F.lit(1 << 30))
        near = training.where(mark < F.lit(int((1 << 30) * min(1.0, 4 * WARM_DOCS / n_docs))))
        some = near.orderBy(mark, "doc_id", F.length("text")).limit(WARM_DOCS).toArrow()
        kept, size = [], 0
        for rows, _ in Words(table).of(some["text"].combine_chunks()):
            for row in rows:
                if size < WARM_TOKENS:
                    kept.append(table.code[row])
                    size += len(row)
        net.start(table, n)
        net.warm(kept)
    shared, flat = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(net.flat)
    if n_docs:
        # a replica for every PIECE tokens, not for every partition of the input
        parts = stored(training.select("text").coalesce(max(1, -(-total // PIECE))).mapInArrow(
            tidy(_replica(shared, flat)), "replica long, block int, tokens long, part binary"), "lm-replicas")
        last = parts.agg(F.max("replica")).first()[0]
        flat = spark.sparkContext.broadcast(_averaged(parts, (last or 0) + 1, net.flat))
    rows = stored(docs.mapInArrow(tidy(_scored(shared, flat)), SCORED), "lm-scored")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    level, unseen = (F.array(*[F.lit(float(x)) for x in v]) for v in (table.level, table.unseen))
    met = rare.join(counts.where(F.col("n") < least), "word", "left")
    seen = F.col("n").isNotNull()
    sums = met.select(
        "row", F.when(seen, F.col("times")).otherwise(0).alias("known"),
        F.when(seen, F.col("times") * F.log10(F.col("n") + 1)).otherwise(F.lit(0.0)).alias("more_base"),
        (F.col("times") * F.when(seen, F.log10(F.col("n") - F.lit(DISCOUNT)) - level[tail])
         .otherwise(unseen[tail])).alias("more")).groupBy("row").agg(
        F.sum("known").alias("known"), F.sum("more_base").alias("more_base"), F.sum("more").alias("more"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.drop("rare", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + none("known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + none("more_base") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (F.col("score") + none("more")).alias("score"))
