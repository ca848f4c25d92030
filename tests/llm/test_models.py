import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from foldmark.llm import gru_lm, secret_scan, toxicity


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def toxic_corpus(n=500):
    rnd, rows, labels = random.Random(3), [], []
    for i in range(n):
        w = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([8, 60, 200]))]
        bad = rnd.random() < 0.3
        for _ in range(2 if bad else 0):
            w[rnd.randrange(len(w))] = rnd.choice(["vile,", "Awful", "nasty."])
        rows.append((i, " ".join(w), ["en", "de", None][i % 3], "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    model = toxicity.fitted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = docs.select("doc_id", toxicity.score(model, docs["text"]).alias("p"),
                      toxicity.threshold(model, docs).alias("t")).collect()
    truth = dict(labels)
    held = [r for r in got if fold(r["doc_id"], 4) == 2]
    assert sum((r["p"] >= r["t"]) == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["p"] <= 1 for r in got)


def test_toxicity_labels_of_the_held_out_fold_do_not_matter(spark):
    rows, labels = toxic_corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    scores = []
    for flip in (0, 1):
        own = [(i, y ^ flip if fold(i, 4) == 2 else y) for i, y in labels]
        model = toxicity.fitted(docs, spark.createDataFrame(own, "doc_id long, toxic int"))
        scores.append([r[0] for r in docs.orderBy("doc_id").select(toxicity.score(model, docs["text"])).collect()])
    assert scores[0] == scores[1]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (4, "x " * 9000)], "doc_id long, text string")
    for labels in ([], [(1, 1), (None, 0), (2, None)], [(1, 0), (2, 1), (4, 1)]):
        model = toxicity.fitted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = [r[0] for r in docs.select(toxicity.score(model, docs["text"])).collect()]
        assert len(got) == 4 and got[0] == got[1] and all(0 <= x <= 1 for x in got)
        assert docs.limit(0).select(toxicity.score(model, docs["text"])).count() == 0


def test_toxicity_thresholds_come_from_all_labels(spark, monkeypatch):
    """However little is fitted on, the cut is that of all unseen labelled rows with the natural mix."""
    rnd, rows, labels = random.Random(4), [], []
    for i in range(1500):
        bad = rnd.random() < 0.12
        # a doubtful word that a tenth of the clean and most of the toxic texts have
        w = [f"w{rnd.randrange(50)}" for _ in range(20)] + (["vile"] if rnd.random() < (0.7 if bad else 0.1) else [])
        rows.append((i, " ".join(w), ["en", "de"][i % 2]))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    calls, plain = [], toxicity.thresholds
    monkeypatch.setattr(toxicity, "thresholds", lambda c, t: calls.append((c, t)) or plain(c, t))
    training = [y for i, y in labels if fold(i, 4) != 2]
    for most in (20, 60):
        model = toxicity.fitted(docs, given, most, most)
        counts, totals = calls[-1]
        assert set(counts) == {"en", "de"} and list(totals) == [len(training) - sum(training), sum(training)]
        assert sum(c.sum() for c in counts.values()) == len(training) - 2 * most
        got = {r[0]: r[1] for r in docs.select("doc_id", toxicity.score(model, docs["text"])).collect()}
        known = [(got[i], y) for i, y in labels if fold(i, 4) != 2]
        f1 = lambda t: 2 * sum(y for s, y in known if s >= t) / (
            sum(s >= t for s, _ in known) + sum(training))
        assert f1(model.overall) >= max(f1(s) for s, _ in known) - 0.03


def test_toxicity_word_budget_is_per_label(spark):
    labels, sizes = [0, 1, 0, 1, 0, 1], [900, 10, 30, 500, 30, 20]
    assert toxicity.fitting(labels, sizes, 3, 4, 100) == [False, True, True, False, False, True]
    assert toxicity.fitting([0, 1, 1], [10, 80, 70], 3, 4, 100) == [True, False, True]
    rows = [(i, ("vile " if i % 4 == 0 else "fine ") * (5000 if i == 17 else 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    for most in (10_000, 1000):  # the long text fits, and does not
        model = toxicity.fitted(docs, given, 60, 60, most)
        got = {r[0]: r[1] for r in docs.select("doc_id", toxicity.score(model, docs["text"])).collect()}
        assert min(got[i] for i in got if i % 4 == 0) > max(got[i] for i in got if i % 4)


def test_pieces_of_a_long_text_give_the_score_of_the_whole(monkeypatch):
    rng = np.random.default_rng(0)
    net = toxicity.Net()
    texts = [rng.integers(0, 2**32, n, np.uint32) for n in (0, 1, 2, 50, 300)]
    whole = net.scores(texts)
    monkeypatch.setattr(toxicity, "PIECE", 37)
    assert np.allclose(net.scores(texts), whole, atol=1e-6)
    assert np.allclose([net.scores([t])[0] for t in texts], whole, atol=1e-6)


def lm_rows():
    rnd, rows = random.Random(5), []
    for i in range(300):
        own = [f"{'ab'[i % 2]}{k}" for k in range(60)]
        rows.append((i, " ".join(rnd.choice(own) + rnd.choice(["", ".", ","]) for _ in range(rnd.choice([3, 40, 90])))))
    return [*rows, (300, None), (301, ""), (302, "Ünknown wörds\x85here \x1cand\tthere"), (None, "a1 b1"), (5, rows[5][1])]


def test_lm_counts_and_held_out_score(spark):
    rows = lm_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rare string").repartition(3)
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    seen = Counter(w for i, ws in tokens for w in ws if i is None or fold(i, 7) != 2)
    n, v = sum(seen.values()), len(seen)
    want = Counter((i, i is not None and fold(i, 7) == 2, len(ws), sum(w in seen for w in ws), n,
                    round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    for common in (50, 100_000):  # words counted by the join, and all in the tasks
        got = gru_lm.score(docs, common).collect()
        assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
        assert all(np.isfinite(r["score"]) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_without_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert gru_lm.score(none).count() == 0
    held = next(i for i in range(100) if fold(i, 7) == 2)
    row = gru_lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert row["score"] < 0


def test_lm_is_a_distribution():
    counts = sorted(((b"w%d" % k, 900 - k) for k in range(800)), key=lambda x: -x[1])
    tail, kinds = np.zeros(gru_lm.TAIL), np.zeros(gru_lm.TAIL)
    for w, n in counts[gru_lm.HEAD:]:
        tail[gru_lm.tail_class(w)] += n
        kinds[gru_lm.tail_class(w)] += 1
    table = gru_lm.Table([w for w, _ in counts], [n for _, n in counts], tail, kinds)
    net = gru_lm.Net()
    net.start(table, [n for _, n in counts])
    state = np.random.default_rng(1).normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    head = np.exp(net.log_p(np.repeat(state, gru_lm.HEAD, 0), np.arange(gru_lm.HEAD, dtype=np.int32))).sum()
    codes = gru_lm.HEAD + np.arange(gru_lm.TAIL, dtype=np.int32)
    classes = np.exp(net.log_p(np.repeat(state, gru_lm.TAIL, 0), codes))
    share = 10.0 ** table.unseen
    for k, (w, _) in enumerate(counts[gru_lm.HEAD:]):
        share[gru_lm.tail_class(w)] += 10.0 ** table.tail[gru_lm.HEAD + k]
    assert np.allclose(share, 1) and abs(head + (classes * share).sum() - 1) < 1e-4


def test_lm_vocabulary_follows_the_counts():
    assert [gru_lm.head_size(c) for c in ([], [9] * 2047, [9] * 2048, [9] * 2047 + [1], [10**6] * 10**6)] == [
        512, 512, 2048, 512, gru_lm.MOST_HEAD]
    counts = [(b"w%d" % k, 9000 - k) for k in range(3000)]
    tail, kinds = np.zeros(gru_lm.TAIL), np.zeros(gru_lm.TAIL)
    for w, n in counts[2048:]:
        tail[gru_lm.tail_class(w)] += n
        kinds[gru_lm.tail_class(w)] += 1
    table = gru_lm.Table([w for w, _ in counts], [n for _, n in counts], tail, kinds)
    net = gru_lm.Net(head=table.head)
    net.start(table, [n for _, n in counts])
    assert (net.head, net.classes) == (2048, 32) and list(table.code[[0, 2047]]) == [0, 2047]
    codes = np.arange(2048 + gru_lm.TAIL, dtype=np.int32)
    state = np.random.default_rng(1).normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    assert abs(np.exp(net.log_p(np.repeat(state, len(codes), 0), codes)).sum() - 1) < 1e-4
    # within a class the state decides, for words beyond the first 512 as well
    two = net.log_p(np.repeat(np.stack([state[0], -state[0]]), 2, 0), np.array([1000, 1001] * 2, np.int32))
    assert abs((two[0] - two[1]) - (two[2] - two[3])) > 1e-3


def test_lm_state_is_carried_through_windows():
    rng = np.random.default_rng(2)
    net = gru_lm.Net()
    texts = [rng.integers(0, gru_lm.HEAD + gru_lm.TAIL, n).astype(np.int32) for n in (1, 700, 30, 333)]

    def plain(codes):
        h, before, total = np.zeros((1, gru_lm.HIDDEN), np.float32), gru_lm.HEAD + gru_lm.TAIL, 0.0
        for c in codes:
            h = net.step(h, net.p["emb"][[before]])[0]
            total += net.log_p(h, np.array([c], np.int32))[0]
            before = c
        return total

    assert np.allclose(net.score(texts), [plain(t) for t in texts], rtol=1e-4)


def test_lm_gradient():
    """One step of training follows the numerical gradient of the loss."""
    rng = np.random.default_rng(3)
    net = gru_lm.Net()
    codes = rng.integers(0, gru_lm.HEAD + gru_lm.TAIL, (7, 5)).astype(np.int32)
    prev = np.vstack([np.full((1, 5), gru_lm.HEAD + gru_lm.TAIL, np.int32), codes[:-1]])
    fresh = np.zeros((7, 5), bool)
    fresh[0] = fresh[3, 2] = True
    prev[3, 2] = gru_lm.HEAD + gru_lm.TAIL

    def loss():
        h, out = np.zeros((5, gru_lm.HIDDEN), np.float32), 0.0
        for t in range(7):
            h = np.where(fresh[t][:, None], 0, h).astype(np.float32)
            h = net.step(h, net.p["emb"][prev[t]])[0]
            out -= net.log_p(h, codes[t]).sum()
        return out / 35

    before = net.flat.copy()
    net.m1, net.m2, net.t = np.zeros_like(net.flat), np.zeros_like(net.flat), 0
    net._window(np.zeros((5, gru_lm.HIDDEN), np.float32), prev, codes, fresh, 0.0)
    grad = net.m1 / 0.1
    for k in np.argsort(-np.abs(grad))[:12]:
        ends = []
        for step in (1e-2, -1e-2):
            net.flat[:] = before
            net.flat[k] += step
            ends.append(loss())
        net.flat[:] = before
        assert abs((ends[0] - ends[1]) / 2e-2 - grad[k]) < 0.05 * abs(grad[k]) + 1e-4


def secret_rows():
    rnd, rows, truth = random.Random(8), [], {}
    hexed = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    for i in range(240):
        kind = i % 4
        text = [f"token = \"{hexed(40)}\" and", f"paid with {rnd.randrange(10**15, 10**16)} today",
                f"key AKIA{''.join(rnd.choice('ABCDEFGHIJ0123456789') for _ in range(15))}7 here",
                f"see /var/lib/{hexed(20)}7/file"][kind]
        rows.append((i, f"some words before {text} words after"))
        truth[i] = kind in (0, 2)
    return rows, truth


def test_secrets_on_held_out_findings(spark):
    rows, truth = secret_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, label int").repartition(3)
    got = secret_scan.scan(docs).collect()
    assert {r["doc_id"] for r in got} == set(truth)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and sum(r["secret"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    given = spark.createDataFrame([(r["doc_id"], r["place"], int(truth[r["doc_id"]])) for r in got],
                                  "doc_id long, place int, label int")
    again = secret_scan.scan(docs, given).where("held_out").collect()
    assert sum(r["secret"] == truth[r["doc_id"]] for r in again) >= 0.95 * len(again)


def test_secret_candidates_and_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "plain wordswithoutanydigitsatall here"),
                                  (4, "a abcdefgh12345678 b\nabcdefgh12345679, zzzzzzzzzzzz0000=="), (None, "x1" * 10),
                                  (5, "w " * 50000 + "password=0123456789abcdef01")], "doc_id long, text string")
    got = secret_scan.scan(docs).collect()
    assert sorted((str(r["doc_id"]), r["place"], r["candidate"]) for r in got) == [
        ("4", 1, "abcdefgh12345678"), ("4", 2, "abcdefgh12345679"), ("4", 3, "zzzzzzzzzzzz0000=="),
        ("5", 1, "0123456789abcdef01"), ("None", 1, "x1" * 10)]
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_secret_values_of_any_kind_and_paths(spark):
    texts = {'password = "hunter2!"': ("hunter2!", 1), "api_key = abcDEFghiJKLmnoPQRstu;": ("abcDEFghiJKLmnoPQRstu", 1),
             'secret: "p@ssw0rd-Long-Enough1"': ("p@ssw0rd-Long-Enough1", 1), "'token' => 'ключ 7'": ("ключ 7", 1),
             "see abcDEFghiJKLmnoPQRstu": ("abcDEFghiJKLmnoPQRstu", None), "password: null": ("null", 0),
             "key wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY here": ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", None),
             "in /var/lib/a7f3909b1c/file.": ("/var/lib/a7f3909b1c/file", 0), "author: Jane": None, "the secret is out": None}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secret_scan.covered(secret_scan.findings(docs), [])
    got = found.select("doc_id", "candidate", secret_scan.evidence(found)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {k: v for k, v in enumerate(texts.values()) if v} and len(got) == 8


def test_every_token_is_trained_on(monkeypatch):
    rnd = np.random.default_rng(3)
    texts = [rnd.integers(0, 300, n).astype(np.int32) for n in [7] * 2000 + [1, 5000]]
    seen = []
    monkeypatch.setattr(gru_lm.Net, "_window", lambda self, h, prev, codes, fresh, rate: seen.append(codes.copy()) or h)
    gru_lm.Net().train(texts, gru_lm.LANES)
    every = np.concatenate([c.ravel() for c in seen])
    assert (np.bincount(every[every != gru_lm.NONE], minlength=300) == np.bincount(np.concatenate(texts), minlength=300)).all()


def test_classes_by_mass():
    for counts, head in ((np.arange(9000, 0, -1), 8192), (np.zeros(0), 512), (np.array([10**9] + [1] * 600), 512), ([5] * 100, 2048)):
        bounds = gru_lm.class_bounds(np.array(counts, float), head)
        assert bounds[0] == 0 and bounds[-1] == head and (np.diff(bounds) > 0).all() and len(bounds) - 1 == int((head // 2) ** 0.5)


def test_lm_softmaxes_of_a_token_are_short(monkeypatch):
    """A token outside the head chooses a group and a class in it, not one of all 176 classes, in scoring and training."""
    cells = []

    def counting(f):
        def run(x, *rest):
            cells.append(x.size)
            return f(x, *rest)
        return run

    for name in ("_log_at", "_misses"):
        monkeypatch.setattr(gru_lm, name, counting(getattr(gru_lm, name)))
    net = gru_lm.Net(head=gru_lm.MOST_HEAD)
    codes = np.arange(4000, dtype=np.int32) % gru_lm.TAIL + net.head
    for work in (lambda: net.score([codes]), lambda: net.train([codes], 1)):
        cells.clear()
        work()
        assert len(codes) <= sum(cells) <= 2 * (1 + (net.classes + gru_lm.TAIL) ** 0.5) * len(codes)


def test_lm_far_logits():
    """Logits that exp cannot bear give the same softmax, and steps of training stay finite."""
    rng = np.random.default_rng(5)
    net = gru_lm.Net()
    states = np.tanh(rng.normal(size=(300, gru_lm.HIDDEN))).astype(np.float32)
    codes = rng.integers(0, gru_lm.HEAD + gru_lm.TAIL, 300).astype(np.int32)
    near = net.log_p(states, codes)
    assert net.plain() and np.allclose(net.log_p(states, codes, False), near, atol=1e-5)
    for far in (300, -300):
        for k in net.pieces:
            net.p[k][:, -1] += far
        assert not net.plain() and np.allclose(net.log_p(states, codes), near, atol=1e-3)
        net.train([codes], 4)
        assert np.isfinite(net.flat).all()
        net = gru_lm.Net()


def test_lm_row_sums():
    rng = np.random.default_rng(6)
    for keys in (rng.zipf(1.3, 5000) % 900, np.zeros(200, int), np.arange(50)):
        keys = keys.astype(np.int32)
        values = rng.normal(size=(len(keys), 6)).astype(np.float32)
        want = np.zeros((900, 6))
        np.add.at(want, keys, values)
        rows, sums = gru_lm._row_sums(values, keys)
        assert sorted(rows) == sorted(set(keys)) and np.allclose(sums, want[rows], atol=1e-3)


def test_lm_words_of_texts(monkeypatch):
    """Words and ends are numbered as plain Python cuts them, whatever is common and however many rows are cut at once."""
    texts = [" a  b\x1c c\x0b\x0cd \x85e f g ", "", None, " ", "\t\n", "ÀB Zz zq A", "end", "q " * 999, "　x"]
    column = pa.array(texts)
    for common in ([gru_lm.END, b"a", b"q", b"zz"], [b"q", b"a"], []):
        table = gru_lm.Table(common, [9] * len(common), np.zeros(gru_lm.TAIL), np.zeros(gru_lm.TAIL))
        place = {w: k for k, w in enumerate(common)}
        want = [[*(t or "").encode().lower().split(), gru_lm.END] for t in texts]
        for size in (1, 1 << 23):
            monkeypatch.setattr(gru_lm, "TEXT", size)
            for some in (column, column.slice(3), column.cast(pa.large_string())):
                got = [x for rows, others in gru_lm.Words(table).of(some) for x in zip(rows, others, strict=True)]
                assert [(list(n), o) for n, o in got] == [
                    ([place.get(w, len(common) + gru_lm.tail_class(w)) for w in ws], [w for w in ws if w not in place])
                    for ws in want[len(texts) - len(some):]]
    assert not list(gru_lm.Words(table).of(column[:0]))
