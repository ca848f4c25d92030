import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldmark.llm import chat, line_clean, mixing, packing, pii

DOCS = "doc_id long, source string, text string, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, "x") for i, s, t in rows], DOCS).repartition(3)


def mixed_rows():
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["hot"] * 6 + ["b", "cé", None, "tiny"]), " ".join(rnd.choice(["ab", "#x", "c d"])
             for _ in range(rnd.choice([0, 1, 20, 60])))) for i in range(400)]
    return [*rows, (400, "empty", None), (401, "empty", ""), (402, "long", "w " * 60000), (7, "hot", rows[7][2]), (None, "b", "x y")]


def test_targets_are_shared_again():
    for sizes in ([10, 10, 10], [1000, 1, 1, 1], [5, 0, 7], [0, 0], [1, 2, 3, 4, 5, 6, 7]):
        w = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
        got = mixing.targets(sizes, w)
        assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 and all(0 <= g <= 2 * s for g, s in zip(got, sizes, strict=True))
        level = {round(g / k, 9) for g, k, s in zip(got, w, sizes, strict=True) if g < 2 * s}
        assert len(level) <= 1  # those below their cap share by weight
        assert all(2 * s / k <= min(level) + 1e-9 for g, k, s in zip(got, w, sizes, strict=True) if g == 2 * s and level)


def test_mix_takes_what_the_targets_say(spark):
    rows = mixed_rows()
    got = mixing.mix(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(spark, rows).repartition(7)).collect()), key=str)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, size(t)) for i, s, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    want = mixing.targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    for s, n, t in zip(names, sizes, want, strict=True):
        assert {r["source_size"] for r in by[s]} == {n} and {r["target"] for r in by[s]} == {t}
        assert abs(sum(r["taken"] for r in by[s]) - t) <= max(r["size"] for r in by[s]) / 2 + 1e-6
        if n:  # whole epochs come first
            assert min(r["times"] for r in by[s] if r["size"]) >= int(t // n)


def test_mixed_rows_repeat(spark):
    rows = mixed_rows()[:405]
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mixed_rows(docs(spark, rows)).collect())
    want = Counter()
    for r in mixing.mix(docs(spark, rows)).collect():
        want[r["doc_id"]] += r["times"]
    seen = Counter()
    for (i, _), n in got.items():
        seen[i] += n
    assert {i: n for i, n in seen.items()} == {i: n for i, n in want.items() if n}
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0


def test_mixed_rows_without_ids_and_with_one_id(spark):
    rows = [(None if k % 2 else 7, "ab"[k % 3 == 0], f"{'w ' * (k % 9 + 1)}{k}") for k in range(100)]
    rows += [(None, "a", "same text here")] * 5
    want, got = Counter(), Counter()
    for r in mixing.mix(docs(spark, rows)).collect():
        want[(r["doc_id"], r["source"], r["size"])] += r["times"]
    kept = mixing.mixed_rows(docs(spark, rows)).collect()
    for r in kept:
        got[(r["doc_id"], r["source"], len(r["text"].split()))] += 1
    assert got == +want and len(kept) != len(rows)
    alone = docs(spark, [(None, "a", f"w {k}") for k in range(100)] + [(1, "b", "x " * 40), (2, "c", "x " * 40)])
    assert mixing.mixed_rows(alone).count() == mixing.mix(alone).agg(F.sum("times")).first()[0]


def test_encoder_equals_the_tokenizer():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own, rnd = packing.Encoder(), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", " \n", "é", "1", ".", "'s", "<|endoftext|>", "<|", "word", "\t", "\x1c", "日本", " ", "\r\n"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert np.frombuffer(own.ids(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("weights", [None, {"hot": 1, "b": 5.0, None: 0.5}])
def test_packing_covers_every_id_once(spark, weights):
    rows = mixed_rows()
    got = packing.packed(docs(spark, rows), weights).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [0] for i, _, t in rows}
    times, pieces, sequences = Counter(i for i, _, _ in rows), defaultdict(Counter), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        part = np.array(own[r["start"]:r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(own)
        pieces[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
        sequences[r["sequence_id"]].append(r)
    assert all(pieces[i] == Counter({k: times[i] for k in range(len(x))}) for i, x in ids.items())
    for s, parts in sequences.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 1024 or s == max(sequences) and at < 1024
    assert sorted(sequences) == list(range(len(sequences)))
    if weights is None:  # up to the end of a window no source is further off its share than two quanta
        total = Counter(r["source"] for r in got for _ in range(r["length"]))
        served = Counter()
        for s in sorted(sequences)[:-1]:
            served.update({k: n for k, n in Counter(r["source"] for r in sequences[s] for _ in range(r["length"])).items()})
            assert all(abs(served[k] - 1024 * (s + 1) * n / sum(total.values())) <= 2 * packing.QUANTUM for k, n in total.items())
    assert packing.packed(docs(spark, rows).limit(0)).count() == 0


def turns():
    rnd, rows = random.Random(2), []
    base = [[("user" if k % 2 == 0 else "assistant", f"turn {c} {k}") for k in range(7)] for c in range(6)]
    for conv in range(80):
        log = base[conv % 6][:rnd.randint(1, 7)]
        if rnd.random() < 0.3:
            log = log[:-1] + [("user", f"own {conv}")]
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(log)]
    rows += [(200, None, "user", "no number"), (200, 0, None, None), (200, 0, "a", "tie"), (200, 0, "a", "tie"), (None, 0, "user", "x"),
             (201, 0, "user", "y" * 100000), (202, 5, "user", "x<|im_end|>")]
    return rows


def test_chat_against_brute_force(spark):
    rows = turns()
    logs = defaultdict(set)
    for c, k, r, t in rows:
        if c is not None:
            logs[c].add((k is None, k or 0, r or "", t or ""))
    logs = {c: tuple((r, t) for _, _, r, t in sorted(x)) for c, x in logs.items()}
    parts = {x[:k] for x in logs.values() for k in range(1, len(x))}
    want = {}
    for x in set(logs.values()) - parts:
        same = [c for c in logs if logs[c] == x]
        text = "".join(f"<|im_start|>{r}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in x)
        want[min(same)] = (min(same), len(x), len(same), text)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int").repartition(4)
    assert {r["conv_id"]: tuple(r) for r in chat.rendered(df).collect()} == want
    assert chat.rendered(df.limit(0)).count() == 0


def test_line_rules():
    bad = ["Home | News | Sport | Mail", "a### b*** c$$$ d%%%", "BUY!! NOW!! CHEAP!! TODAY!!", "ALL OF THIS IS LOUD", "About us",
           "We use technology; this site uses cookies to work."]
    good = ["A plain sentence with several words.", "Yes.", "a line of prose that simply has no stop at its end",
            "NASA and ESA launched the probe in May.", "Größe und Maß: drei Äpfel"]
    assert all(line_clean.fails(x, line_clean.words_of(x)) for x in bad)
    assert not any(line_clean.fails(x, line_clean.words_of(x)) for x in good)


def test_texts_with_entities_are_found_by_cheap_looks_first(spark):
    """Every text went through all patterns at every character; the looks before them lose no match and change none."""
    texts = ["x" * 70 + "@a.b.com y", "a@b.c-d.org", "+1 (2) 3 4 5 6 7 8", "(0171) 123-4567 ", "John Smith, Анна Петрова, Annas", "1.2.3.4.5 and 10.0.0.1",
             "4111 1111 1111 1111", "xJohn", "Мария", "a@b", "..@x.yy", None, "", "Élan Emma", "0049 30 1234567", "ЁАнна", "7 of 9", "no one"]
    plain = [p.replace("{1,64}+", "{1,64}").replace("{1,63}+", "{1,63}").replace(f"(?={pii._INITIAL})", "") for p in pii.PATTERNS.values()]
    whole = "|".join(f"(?:{p})" for p in plain)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = df.select("doc_id", pii.holds_entity(F.col("text")), F.coalesce(F.col("text").rlike(whole), F.lit(False)),
                    F.regexp_extract_all("text", F.lit(pii.ANY), F.lit(0)), F.regexp_extract_all("text", F.lit(whole), F.lit(0))).collect()
    assert all(r[1] == r[2] and r[3] == r[4] for r in got) and {r[1] for r in got} == {True, False}
    assert all(set(n[0]) <= set("".join(map(chr, range(0x410, 0x430)))) for k in pii.NAMES if "cyrillic" in k for n in pii.NAMES[k])


def test_surrogates_are_worked_out_by_many_tasks(spark, monkeypatch):
    """Small bytes and much work: merged by size, all entities of a corpus were one task."""
    seen, real = {}, pii.stored
    monkeypatch.setattr(pii, "stored", lambda df, name: seen.setdefault(name, real(df, name)))
    df = spark.createDataFrame([("email", f"m{k}@example.com") for k in range(200)], "kind string, entity string").distinct()
    pii.surrogates(df, "k").count()
    files = {r[0] for r in seen["pii-attempt"].select(F.input_file_name()).distinct().collect()}
    assert len(files) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_line_cleaning_judges_raw_utf8():
    """Texts were decoded and searched by patterns character by character; bytes give the same counts of code points and words."""
    raw = "Ünï\u00a0x À\x0bb… K!! a!!\n|\na b c d a b c\na b c d a b c\nİ ROOT ÜBER ALL\n ende »".encode()
    assert line_clean.judged(raw) == (26, 46, 1, 1, 14, 12, "Ünï\u00a0x À\x0bb… K!! a!!\na b c d a b c\n ende »".encode())
    assert line_clean.repeated_words(b"a b c d e f a b c".split()) == 6 and line_clean.repeated_words(b"a b c".split()) == 0


def test_line_cleaning_counts(spark):
    prose = "\n".join(f"Sentence {k} tells of thing{k} and place{k} in some length." for k in range(12))
    texts = {1: prose, 2: None, 3: "", 4: prose + "\nHome | Up | Next", 5: "\n".join(["Menu | A | B | C | D"] * 2 + [prose[:200]]),
             6: "same words here " * 30, 7: prose + "\n" + prose.split("\n")[0], 8: "w " * 60000, 9: "é ü ñ\x1cx", 10: "a b a b a b c"}
    df = spark.createDataFrame([(i, t, 5) for i, t in texts.items()] + [(None, prose, 1)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in line_clean.clean(df.repartition(3)).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + d for k in range(len(w) - 2) if win[tuple(w[k:k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert got[1]["kept"] and got[1]["cleaned"] == prose and got[4]["kept"] and got[4]["cleaned"] == prose
    assert not got[5]["kept"] and got[7]["lost_words"] == 10 and got[None]["kept"]
    assert line_clean.clean(df.limit(0)).count() == 0


def test_surrogates_keep_type_format_and_identity(spark):
    text = "Mail anna.lee42@mail7.example.com or ANNA.LEE42@mail7.example.com, call +49 (286) 555-5136, from 10.0.0.7. " \
           "Card 4111 1111 1111 1111. Anna Müller met Иван Петров and Anna Müller; Marie left. Ip 10.0.0.7 again."
    rows = [(1, text), (2, "x 10.0.0.7 y"), (3, None), (4, ""), (5, "nothing here"), (None, "bob@x.org"), (6, "x 10.0.0.7 y"), (7, "a " * 50000 + "bob@x.org")]
    got = {r["doc_id"]: r for r in pii.replaced(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_entities int")
                                                .repartition(3)).collect()}
    assert len(got) == 8 and got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "nothing here"
    one = defaultdict(set)
    for r in got.values():
        for e in r["entities"] or []:
            one[e["kind"], e["value"].lower()].add(e["surrogate"].lower())
            assert len(e["value"]) == len(e["surrogate"]) or e["kind"] in ("ip", "name")
            assert e["surrogate"] in r["text"] and e["value"] not in r["text"]
    assert all(len(x) == 1 for x in one.values())
    assert len({next(iter(x)) for x in one.values()}) == len(one)
    kinds = Counter(e["kind"] for e in got[1]["entities"])
    assert kinds == {"email": 2, "phone": 1, "ip": 2, "card": 1, "name": 4}
    by = {e["value"]: e["surrogate"] for e in got[1]["entities"]}
    digits = [int(c) for c in by["4111 1111 1111 1111"] if c.isdigit()]
    assert sum(d if k % 2 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(digits)) % 10 == 0
    assert by["+49 (286) 555-5136"].startswith("+49 (") and all(0 < int(p) < 256 for p in by["10.0.0.7"].split("."))
    assert re.fullmatch(r"[А-Я][а-я]+ [А-Я][а-я]+", by["Иван Петров"]) and by["Иван Петров"].split()[0] in pii.NAMES["m_cyrillic"]
    assert by["Marie"] in pii.NAMES["f_latin"] and by["anna.lee42@mail7.example.com"].endswith(".com")
    assert got[2]["text"] == got[6]["text"] and got[7]["text"].startswith("a a ")


def test_surrogates_stay_distinct_in_a_crowded_format(spark, monkeypatch):
    monkeypatch.setattr(pii, "RETRIES", 2)  # the format has room for fewer than the entities
    mails = [f"{a}@{b}.io" for a in "aeiou" for b in "aei"]
    df = spark.createDataFrame([("email", m) for m in mails], "kind string, entity string")
    got = pii.surrogates(df, "k").collect()
    new = [r["surrogate"] for r in got]
    assert sorted(r["entity"] for r in got) == sorted(mails) and len(set(new)) == len(mails) and not set(new) & set(mails)
    again = {r["entity"]: r["surrogate"] for r in pii.surrogates(df.repartition(5), "k").collect()}
    assert again == {r["entity"]: r["surrogate"] for r in got}
    assert pii.surrogates(df.limit(0), "k").count() == 0
    assert pii.replaced(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pii_phone_and_card_shapes_and_bare_surnames(spark):
    phones = ["+14155550123", "+49 30 1234567", "(310) 555-4510", "310-555-4510", "+1 (310) 555-4510", "030 1234567"]
    cards = ["378282246310005", "3782 822463 10005", "4222222222222", "6304000000000000000"[:18] + "0"]
    luhn = lambda x: sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(
        reversed(re.sub(r"[^0-9]", "", x)))) % 10
    cards = [c for c in cards if luhn(c) == 0]
    rows = [(k, f"see {x}, please") for k, x in enumerate(phones + cards)]
    rows += [(50, "no card 378282246310004 here"), (51, "Brandt met Emma Brandt and Paul Novak; Novak left, Brandt, too. Brandts"),
             (52, "Brandt alone")]
    got = {r["doc_id"]: r for r in pii.replaced(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, x in enumerate(phones + cards):
        (e,), kind = got[k]["entities"], "phone" if k < len(phones) else "card"
        assert (e["kind"], e["value"]) == (kind, x) and e["surrogate"] != x
        assert got[k]["text"] == f"see {e['surrogate']}, please"
        assert re.sub("[0-9]", "0", e["surrogate"]) == re.sub("[0-9]", "0", x) and (kind == "phone" or luhn(e["surrogate"]) == 0)
    assert len(cards) >= 3 and got[0]["text"].startswith("see +1")
    assert (got[50]["text"], got[50]["n_entities"]) == (rows[-3][1], 0) and got[52]["text"] == "Brandt alone"
    full = {e["value"]: e["surrogate"] for e in got[51]["entities"]}
    a, b = full["Emma Brandt"], full["Paul Novak"]
    assert got[51]["text"] == "{0} met {1} and {2}; {3} left, {0}, too. Brandts".format(a.split()[1], a, b, b.split()[1])
    assert got[51]["n_entities"] == 5 and [e["value"] for e in got[51]["entities"]] == [
        "Brandt", "Emma Brandt", "Paul Novak", "Novak", "Brandt"]
