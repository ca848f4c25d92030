import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from foldmark.llm import exact_dedup, near_dedup
from foldmark.llm.components import components

SCHEMA = "doc_id long, text string, kept string, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "en") for i, t in rows], SCHEMA).repartition(3)


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 100, 5000):
        for width in (64, 61, 13 if n < 5000 else 40):
            x = np.unique(rng.integers(0, 2**width, n, np.uint64, endpoint=width < 64) & np.uint64(2**width - 1))
            assert (exact_dedup.unpacked(exact_dedup.golomb(x, width), len(x), width) == x).all()


def test_exact_groups_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["Ab c", "aB C", "ab c ", None, "", "É", "é", "x" * 90000, f"own {i}"])) for i in range(200)]
    want, groups = {}, defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    for text, ids in groups.items():
        for i in ids:
            want[i] = (i, max(ids), len(ids), i == max(ids), hashlib.sha256(text).hexdigest())
    for owners in (None, 1, 64):
        got = exact_dedup.exact_groups(frame(spark, rows), owners).collect()
        assert {r["doc_id"]: tuple(r) for r in got} == want and len(got) == 200


def test_exact_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "z"), (None, "z"), (7, "q")]
    got = [tuple(r)[:4] for r in exact_dedup.exact_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 1, 3, False), (1, 1, 3, True), (None, 1, 3, False), (1, 1, 1, True), (None, None, 2, False),
         (None, None, 2, True), (7, 7, 1, True)], key=str)
    left = exact_dedup.without_copies(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted(
        [(1, "a"), (1, "b"), (None, "z"), (7, "q")], key=str)


def words(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (i, len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus():
    """Copies, chains, a star around a base text, shared passages, short and empty texts."""
    rnd, rows = random.Random(9), []
    add = lambda w: rows.append((len(rows) * 3 + 1, " ".join(w) if isinstance(w, list) else w))
    base = words(rnd, 150)
    for edits in [0, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 8, 8, 10] * 4:
        w = list(base)
        for k in rnd.sample(range(len(w)), edits):
            w[k] = "e" + str(rnd.randrange(10**6))
        add(w)
    chain = words(rnd, 120)
    for k in range(12):  # each link is similar, the ends are not
        chain = chain[6:] + words(rnd, 6)
        add(list(chain))
    passage = words(rnd, 60)
    for _ in range(25):
        add(words(rnd, 70) + passage)
    for t in (None, "", " \t\n", "one", "One", "one two three", "one two three four five six", "Ünï cödé"):
        add(t)
        add(t)
    for _ in range(30):
        add(base)
    add(words(rnd, 30000))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [16])
def test_near_groups_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "MEETING", block)
    monkeypatch.setattr(near_dedup, "MEMBERS", block)
    rows = corpus()
    got = {r["doc_id"]: tuple(r) for r in near_dedup.near_groups(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_near_without_ids_and_repeated_rows(spark):
    text = " ".join(f"t{k}" for k in range(40))
    rows = [(5, text), (5, text), (9, text + " more"), (None, text), (None, text)]
    got = sorted(map(tuple, near_dedup.near_groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 36, 5, True), (5, 36, 5, True), (9, 37, 5, False), (None, 36, None, True),
                          (None, 36, None, True)], key=str)
    assert sorted(str(r["doc_id"]) for r in near_dedup.one_of_each(frame(spark, rows)).collect()) == ["5", "5", "None", "None"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(none).count() == near_dedup.near_groups(none).count() == 0
    assert exact_dedup.without_copies(none).columns == near_dedup.one_of_each(none).columns == none.columns


def test_components_of_random_graphs(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 540)]
    links += [(1000, k) for k in range(900, 990)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
