"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (A-Z lower-cased, ASCII punctuation stripped from its ends) has a 32-bit hash; its two halves
pick a row from each of two embedding tables, so two words look alike only when both
halves collide. Filters of widths 1, 2 and 3 slide over the whole text, their maxima
feed a logistic output. Training sees at most POSITIVES + NEGATIVES labelled
documents (in hash order) and at most SAMPLE_WORDS words of them (shared by the labels as the rows are; a text
that no longer fits is left out and the next ones are tried), none of them from the tenth of the
labels that is held back. One threshold per language is calibrated on every labelled row of the training folds that the
fit did not see: Spark scores them all and counts them by language, label and bin of the score, and each label
weighs what it has among all labelled rows, so the cut means the same whatever share of a label was fitted on. The
language picks a threshold and never enters a score.

Rows: null text counts as empty; an empty text has the score of no evidence. A very
long text is scored whole, in overlapping pieces. A row without doc_id, or whose language
is null or has fewer than RARE unseen rows of either label, uses the threshold of all languages together; for
the others the counts of all languages are added, scaled to RARE rows of label 1. With no unseen rows of both labels
all labelled rows are fitted on and calibrate, too. Rows with null labels are not
trained on; with no labels of both classes every score is the share of label 1. Repeated
rows are scored alike; extra columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import IdFilter, fold, raw_texts, stored, tidy

HALF = 1 << 16
WIDTH, FILTERS, SPANS = 8, 16, (1, 2, 3)
POSITIVES, NEGATIVES, SAMPLE_WORDS = 3000, 4000, 8_000_000
EPOCHS, STEPS, BATCH, RATE = 6, 800, 32, 0.1  # at least so many epochs, and steps as far as TRAIN_WORDS go
TRAIN_WORDS = 12_000_000
PIECE = 1 << 15
TENTH = 10  # one label in so many is never fitted on
BINS, FAR, RARE = 4096, 16.0, 10  # bins of the log odds between -FAR and FAR
STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordHashes(dict):
    most = 250_000

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word.strip(STRIP))
        return value


def hashed(text, hashes):
    words = text.lower().split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint32, len(words))


class Net:
    """Two embedding tables, filters of three widths, one logistic output."""

    def __init__(self, prior=0.5, seed=11):
        rng = np.random.default_rng(seed)
        d = 2 * WIDTH
        self.tables = [rng.normal(0, 0.1, (HALF, WIDTH)).astype(np.float32) for _ in range(2)]
        self.filters = [rng.normal(0, (2 / (d * s)) ** 0.5, (s, d, FILTERS)).astype(np.float32) for s in SPANS]
        self.bias = np.zeros(len(SPANS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, len(SPANS) * FILTERS).astype(np.float32)
        p = min(max(prior, 1e-3), 1 - 1e-3)
        self.level = np.float32(np.log(p / (1 - p)))

    def embedded(self, ids):
        return np.concatenate([self.tables[0][ids & 0xFFFF], self.tables[1][ids >> 16]], axis=1)

    def pooled(self, texts, where=False, cut=None):
        """Largest filter response per text (and the place it comes from).

        ``cut`` tells for each text whether its start and its end are cuts inside a longer
        one; responses that reach over a cut are left to the neighbouring piece.
        """
        gap = max(SPANS) - 1  # zero vectors between texts, so that every text has all widths
        lengths = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths + gap)[:-1]]) + gap
        e = np.zeros((int((lengths + gap).sum()) + 2 * gap, 2 * WIDTH), np.float32)
        inside = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        if len(inside):
            e[inside] = self.embedded(np.concatenate(texts))
        n = len(e) - gap
        top, at = [], []
        for s, f in zip(SPANS, self.filters, strict=True):
            z = e[:n] @ f[0]
            for j in range(1, s):
                z += e[j:n + j] @ f[j]
            # the responses of a text start where its last gap begins
            first, last = starts - (s - 1), starts + lengths
            if cut is not None:
                first = first + (s - 1) * cut[:, 0]
                last = last - (s - 1) * cut[:, 1]
            first = np.minimum(first, last - 1)  # an empty text has the response of nothing
            if where:
                peak = np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(first, last, strict=True)])
                at.append(peak)
                top.append(z[peak, np.arange(FILTERS)])
            else:
                edges = np.stack([first, np.minimum(last, n)], axis=1).ravel()
                if edges[-1] >= n:
                    edges = edges[:-1]
                top.append(np.maximum.reduceat(z, edges)[::2])
        top = np.concatenate(top, axis=1)
        return (top, at, e, inside) if where else top

    def logits(self, top):
        return np.maximum(top + self.bias, 0) @ self.out + self.level

    def scores(self, texts):
        """One score per text; long texts in pieces that overlap by a filter's reach."""
        out, run, owners, cuts, words = np.full((len(texts), len(self.out)), -np.inf, np.float32), [], [], [], 0
        reach = max(SPANS) - 1

        def flush():
            if run:
                np.maximum.at(out, np.array(owners), self.pooled(run, cut=np.array(cuts)))
                for x in (run, owners, cuts):
                    x.clear()

        for k, text in enumerate(texts):
            for a in range(0, max(1, len(text) - reach), PIECE):
                piece = text[a:a + PIECE + reach]
                if words + len(piece) > PIECE:
                    flush()
                    words = 0
                run.append(piece)
                owners.append(k)
                cuts.append((a > 0, a + len(piece) < len(text)))
                words += len(piece)
        flush()
        return 1 / (1 + np.exp(-self.logits(out).astype(np.float64)))

    def fit(self, texts, labels, epochs=None, seed=5):
        """Adagrad on the logistic loss; gradients flow through the pooled places only."""
        rng = np.random.default_rng(seed)
        squares = [np.full((HALF, 1), 1e-3, np.float32) for _ in range(2)]
        others = [*self.filters, self.bias, self.out]
        sums = [np.full_like(p, 1e-3) for p in others]
        most = TRAIN_WORDS // max(1, sum(map(len, texts)))
        for _ in range(epochs or max(EPOCHS, min(STEPS * BATCH // len(texts), most))):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                pick = order[a:a + BATCH]
                own = [texts[k] for k in pick]
                top, at, e, inside = self.pooled(own, where=True)
                active = np.maximum(top + self.bias, 0)
                miss = (1 / (1 + np.exp(-(active @ self.out + self.level))) - labels[pick]).astype(np.float32) / len(pick)
                back = np.where(active > 0, miss[:, None] * self.out, 0).astype(np.float32)
                grads, moved = [], np.zeros_like(e)
                for k, (s, f) in enumerate(zip(SPANS, self.filters, strict=True)):
                    g = back[:, k * FILTERS:(k + 1) * FILTERS]
                    grad = np.empty_like(f)
                    for j in range(s):
                        grad[j] = np.einsum("bfd,bf->df", e[at[k] + j], g)
                        np.add.at(moved, (at[k] + j).ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, 2 * WIDTH))
                    grads.append(grad)
                grads += [back.sum(axis=0), miss @ active]
                for p, q, g in zip(others, sums, grads, strict=True):
                    q += g * g
                    p -= RATE * g / np.sqrt(q)
                if len(inside):
                    ids, delta = np.concatenate(own), moved[inside]
                    hit = np.flatnonzero(np.abs(delta).sum(axis=1))
                    for t, rows in enumerate((ids[hit] & 0xFFFF, ids[hit] >> 16)):
                        part = delta[hit, t * WIDTH:(t + 1) * WIDTH]
                        rows, place = np.unique(rows, return_inverse=True)
                        g = np.zeros((len(rows), WIDTH), np.float32)
                        np.add.at(g, place, part)
                        squares[t][rows] += (g * g).sum(axis=1, keepdims=True)
                        self.tables[t][rows] -= RATE * g / np.sqrt(squares[t][rows])
        return self


def odds(p):
    return np.log(min(max(p, 1e-3), 1 - 1e-3) / (1 - min(max(p, 1e-3), 1 - 1e-3)))


def bins(scores):
    """Bin of each score, by its log odds."""
    s = np.clip(scores, 1e-12, 1 - 1e-12)
    return np.clip((np.log(s / (1 - s)) + FAR) * (BINS / (2 * FAR)), 0, BINS - 1).astype(np.int64)


def best_threshold(counts):
    """Cut with the highest F1 of (label, bin) counts, in the middle of the empty bins around it."""
    used = np.flatnonzero(counts.sum(axis=0))[::-1]
    hits, taken = np.cumsum(counts[1, used]), np.cumsum(counts[:, used].sum(axis=0))
    k = int(np.argmax(2 * hits / (taken + counts[1].sum())))
    low = used[k + 1] + 1 if k + 1 < len(used) else 0
    edge = (used[k] + low) / 2 * (2 * FAR / BINS) - FAR
    return float(1 / (1 + np.exp(-edge)))


def thresholds(counts, totals):
    """Cut of all languages, and of each language with RARE rows of both labels.

    ``counts`` has (label, bin) counts of unseen rows per language (None for no language), ``totals``
    the number of all labelled rows of each label.
    """
    every = sum(counts.values())
    weight = (np.array(totals) / np.maximum(every.sum(axis=1), 1))[:, None]
    every = every * weight
    more = every * (RARE / every[1].sum())
    return best_threshold(every), {name: best_threshold(own * weight + more) for name, own in counts.items()
                                   if name is not None and own.sum(axis=1).min() >= RARE}


class Model:
    """A trained net and its thresholds; the net travels to the executors once."""

    def __init__(self, spark, net, overall, by_language):
        self.shared = spark.sparkContext.broadcast(net)
        self.overall, self.by_language = overall, by_language


def _known(labels):
    """Labels 0 and 1 of the training folds with the mark that puts them in order."""
    mark = F.xxhash64(F.col("doc_id"), F.lit("toxicity")).alias("mark")
    return (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"), mark)
            .where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(fold("doc_id", 4) != 2))


def _lang(docs):
    return (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang")


def _sample(docs, known, positives, negatives):
    """Hashed words of documents with these labels, at most ``positives`` + ``negatives`` rows."""
    part = [known.where(f"toxic = {t}").orderBy("mark", "doc_id").limit(n) for t, n in ((1, positives), (0, negatives))]
    chosen = part[0].unionByName(part[1])

    def words(batches):
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([hashed(t, hashes).tobytes() for t in raw_texts(batch.column(3))], pa.binary())],
                ["toxic", "mark", "lang", "ids"])

    rows = docs.select("doc_id", _lang(docs), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("toxic", "mark", "lang", "text").mapInArrow(
        tidy(words), "toxic int, mark long, lang string, ids binary")
    return stored(rows, "toxic-sample")


def _unseen_counts(docs, known, model, marks):
    """(label, bin) counts per language of all labelled rows whose mark is not among ``marks``.

    Texts are scored where they lie; only id, language and bin meet the labels.
    """
    seen = docs.sparkSession.createDataFrame(pa.table({"mark": pa.array(marks, pa.int64())}))
    left = stored(known.join(F.broadcast(seen), "mark", "left_anti").select("doc_id", "toxic"), "toxic-unseen")
    texts = IdFilter(left.select("doc_id").distinct()).rows(docs.select("doc_id", _lang(docs), "text"))
    scored = texts.select("doc_id", "lang", score(model, F.col("text")).alias("score"))
    odd = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), "score"))
    place = F.floor((F.log(odd / (1 - odd)) + FAR) * (BINS / (2 * FAR)))
    scored = scored.select("doc_id", "lang", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).alias("bin"))
    got = (scored.join(left, "doc_id").groupBy("lang", "toxic", "bin").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pydict())
    return _counted(got["lang"], got["toxic"], got["bin"], got["n"])


def _counted(langs, labels, places, n):
    out = {}
    for name, t, b, k in zip(langs, labels, places, n, strict=True):
        out.setdefault(name, np.zeros((2, BINS)))[int(t), b] += k
    return out


def fitting(labels, sizes, positives, negatives, most_words):
    """Which texts, in the order given, fit into the words of their label; one too long makes room for the next.

    The labels share the words as they share the rows. Where no text of a label fits, its shortest
    is taken if all words together have room for it.
    """
    room = {1: most_words * positives // (positives + negatives)}
    room[0] = most_words - room[1]
    kept = []
    for t, n in zip(labels, sizes, strict=True):
        kept.append(n <= room[t])
        room[t] -= n * kept[-1]
    for t in room:
        own = [k for k, x in enumerate(labels) if x == t]
        if own and not any(kept[k] for k in own):
            k = min(own, key=lambda k: sizes[k])
            kept[k] = sizes[k] <= most_words
    return kept


def fitted(docs, labels, positives=POSITIVES, negatives=NEGATIVES, most_words=SAMPLE_WORDS):
    """Model from ``labels`` (doc_id, toxic) outside the held-out fold and the texts of ``docs``."""
    known = _known(labels)
    tenth = F.pmod("mark", F.lit(TENTH)) == 0
    share = known.groupBy("toxic", tenth.alias("back")).count().toArrow().to_pydict()
    counts, total = dict(zip(zip(share["toxic"], share["back"], strict=True), share["count"], strict=True)), sum(share["count"])
    prior = sum(n for (t, _), n in counts.items() if t) / total if total else 0.0
    got = None
    for part in ([known.where(~tenth)] if len(counts) == 4 else []) + [known]:
        rows = _sample(docs, part, positives, negatives)
        sizes = (rows.groupBy("toxic", "mark").agg(F.sum(F.length("ids") / 4).cast("long").alias("n")).orderBy("mark")
                 .toArrow().to_pydict())
        kept = fitting(sizes["toxic"], sizes["n"], positives, negatives, most_words)
        if not all(kept):
            keep = pa.table(sizes).filter(pa.array(kept)).select(["toxic", "mark"])
            rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(keep)), ["toxic", "mark"])
        got = rows.orderBy("mark", "toxic", "ids").toArrow().to_pydict()
        if len(set(got["toxic"])) == 2:
            break
    texts = [np.frombuffer(x, np.uint32) for x in got["ids"]]
    y = np.array(got["toxic"], np.float64)
    if len(set(got["toxic"])) < 2:
        net = Net(prior)
        net.out[:] = 0
        return Model(docs.sparkSession, net, 0.5, {})
    net = Net(y.mean()).fit(texts, y)
    # the sample holds more of label 1 than all labels do: move the intercept accordingly
    net.level = np.float32(net.level + odds(prior) - odds(y.mean()))
    model = Model(docs.sparkSession, net, 0.5, {})
    unseen = _unseen_counts(docs, known, model, sorted(set(got["mark"])))
    every = sum(unseen.values()).sum(axis=1) if unseen else np.zeros(2)
    seen = np.array([(y == 0).sum(), (y == 1).sum()])
    if not every.all():
        unseen, every = _counted(got["lang"], got["toxic"], bins(net.scores(texts)), [1] * len(y)), np.zeros(2)
    model.overall, model.by_language = thresholds(unseen, seen + every)
    return model


def score(model, text):
    """Column of scores (0 to 1) of a text column."""
    shared = model.shared

    @F.arrow_udf(DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def run(batches):
            hashes = WordHashes()
            for batch in batches:
                out = [np.zeros(0)]
                for a in range(0, len(batch), 256):
                    out.append(shared.value.scores([hashed(t, hashes) for t in raw_texts(batch.slice(a, 256))]))
                yield pa.array(np.concatenate(out))

        yield from tidy(run)(batches)

    return scores(text)


def threshold(model, docs):
    """Column of the threshold that holds for a row of ``docs``."""
    if "lang" not in docs.columns or not model.by_language:
        return F.lit(model.overall)
    table = F.create_map(*[F.lit(x) for pair in model.by_language.items() for x in pair])
    return F.coalesce(table[F.col("lang").cast("string")], F.lit(model.overall))
