import hashlib
import random
import zlib

import pytest

from foldmark.llm import lz_prints, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, span string, digest string"


def frame(spark, rows):
    full = [(*r, *("de", None, 3)[len(r) - 2:], "t", "s", "d") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def phrases(text):
    known, out = set(), ""
    for c in text:
        out += c
        if out not in known:
            known.add(out)
            out = ""
    return known


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rnd = random.Random(8)
    words = ["the", "été", "ab", "王伟", "x" * 9, "a\nb", "\0", "naïve"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "a"), (203, "aaaaaaa"), (204, "ab" * 3000)]
    rows += [(205, "long " * 200_000 + "end"), (207, "z" * 1_000_000), (300, rows[4][1])]
    return rows


@pytest.mark.parametrize("ranges", [1, 4, 60])
def test_lz_against_a_plain_parse(spark, ranges):
    rows = texts()
    got = {r["doc_id"]: r for r in lz_prints.compared(frame(spark, rows), ranges).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = phrases(text), phrases(edited), phrases(after)
        for near, x in (("near_edited", b), ("near_next", c)):
            if len(a | x) <= lz_prints.SIZE:
                assert r[near] == pytest.approx(share(a, x)), (i, near)
            else:
                assert abs(r[near] - share(a, x)) < 0.3
        for name, x in (("fingerprint", a), ("edited_fingerprint", b)):
            assert r[name] == lz_prints.written_out(lz_prints.signature(x))
    assert got[300]["fingerprint"] == got[4]["fingerprint"]


def test_lz_estimate_is_close():
    rnd = random.Random(1)
    base = [rnd.randrange(10**9) for _ in range(3000)]
    errors = []
    for common in (0, 300, 1500, 2700):
        a = {str(x) for x in base}
        b = {str(x) for x in base[:common]} | {f"n{k}" for k in range(3000 - common)}
        errors.append(abs(lz_prints.likeness(lz_prints.signature(a), lz_prints.signature(b)) - share(a, b)))
    assert max(errors) < 0.2 and sum(errors) / 4 < 0.1


def test_lz_missing_ids_repeats_and_few_rows(spark):
    rows = [(5, "bb cc"), (5, "aa"), (5, "aa"), (None, "z z z z"), (None, None)]
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in lz_prints.compared(frame(spark, rows), 3).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # in order: 5 aa, 5 aa, 5 bb cc, None (empty), None z z z z
    assert got == sorted([("5", 2, sha("aa")), ("5", 2, sha("ab")), ("5", 5, sha("bb ")), ("None", 0, sha("")),
                          ("None", 7, sha("z z aa"))])
    one = lz_prints.compared(frame(spark, [(9, "abcdef")])).collect()
    assert [(r["n_chars"], r["edited_sha256"], r["near_next"]) for r in one] == [(6, sha("abcabc"), 1.0)]
    assert lz_prints.compared(frame(spark, [])).count() == 0
    nulls = lz_prints.compared(frame(spark, [(None, "ab"), (None, "ab")])).collect()
    assert [r["near_next"] for r in nulls] == [1.0, 1.0]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    i, _, lang, source, n = row
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(level, fan):
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[k:k + fan]) for k in range(0, len(last), fan)])
    return levels


def siblings(levels, at, fan):
    out = []
    for level in levels[:-1]:
        first = at // fan * fan
        run = level[first:first + fan]
        out.append((run[:at - first], run[at - first + 1:]))
        at //= fan
    return out


def brute_manifest(rows, fan):
    trees, out = {}, []
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        built[name] = climb([leaf(r, r[1]) for r in trees[name]], fan)
    top = climb([built[n][-1][0] for n in names], fan)
    for k, name in enumerate(names):
        for at, r in enumerate(trees[name]):
            steps = siblings(built[name], at, fan) + siblings(top, k, fan)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            d = leaf(r, text)
            for left, right in steps:
                d = sha(*left, d, *right)
            out.append((r[0], leaf(r, r[1]), built[name][-1][0], top[-1][0], sha(*(x for s in steps for half in s for x in half)),
                        d, d == top[-1][0]))
    return out


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_manifest_against_brute_force(spark, fan):
    rnd = random.Random(fan)
    langs = ["en"] * 6 + ["de", "fr", "é", None, ""] + [f"l{k}" for k in range(7)]
    rows = [(i, rnd.choice(["Abc", "abc", "", None, "É:1-", "Long " * 1000 + str(i)]), rnd.choice(langs), rnd.choice(["s", None]),
             rnd.choice([None, i])) for i in range(140)]
    rows += [(7, "again", "en", None, 1), (7, "again", "en", None, 1), (None, "No id", "en", "s", 2), (None, None, None, None, None)]
    rows += [(900, "X" * 1_000_000, "only", "s", 1)]
    got = merkle.manifest(frame(spark, rows), fan).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(rows, fan)))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0
    rows = [(3, "A", "en", "s", 1)]
    assert [tuple(r) for r in merkle.manifest(frame(spark, rows)).collect()] == brute_manifest(rows, 8)
