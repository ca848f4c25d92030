"""Columns with the operators' own names, nulls, repeated rows, a long text and an empty table, for operators and stages alike."""

import pytest
from pyspark.sql import functions as F

from foldmark.llm import chat, line_clean, lz_prints, merkle, mixing, packing, pii, repair, secret_scan
from foldmark.llm.exact_dedup import exact_groups, without_copies
from foldmark.llm.near_dedup import near_groups, one_of_each

NAMES = ["_n", "_key", "_id", "_of", "_times", "_rows", "_copy", "_place", "_row_of_text", "_toxic_score", "row", "new_text", "place",
         "piece", "entity", "kind", "value", "surrogate", "_slot_of_filter", "span", "tree", "idx", "digest", "sender", "node", "root",
         "bucket", "entities", "n_entities", "conv", "seq", "one", "key", "name", "size", "target", "words", "extra"]
TEXTS = ["Call Peter Miller at +1 (310) 555-4510 or mail p.miller@example.org today, please. " * 3, None, "", "a b c d e f g", "a b c d e f g",
         "long words of a very long text " * 40_000]


def table(spark):
    rows = [(k if k != 6 else None, t, "en", ("s", None)[k % 2], 5) for k, t in enumerate(TEXTS + TEXTS[3:5])] + [(3, "a b c d e f g", "en", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in NAMES])


@pytest.mark.parametrize("stage", [without_copies, one_of_each, mixing.mixed_rows])
def test_stages_keep_every_column(spark, stage):
    docs = table(spark)
    out = stage(docs)
    assert out.columns == docs.columns and out.count() > 0
    for r in out.select(*NAMES).distinct().collect():
        assert list(r) == [f"mine {n}" for n in NAMES]
    assert stage(docs.limit(0)).count() == 0


def test_surrogates_keep_every_column(spark):
    docs = table(spark)
    out = pii.replaced(docs)
    kept = [n for n in NAMES if n not in ("entities", "n_entities")]
    assert out.count() == docs.count() and {tuple(r) for r in out.select(*kept).collect()} == {tuple(f"mine {n}" for n in kept)}
    assert out.where("doc_id = 0").first()["n_entities"] > 0


@pytest.mark.parametrize("operator", [exact_groups, near_groups, mixing.mix, packing.packed, line_clean.clean, secret_scan.scan,
                                      lz_prints.compared, merkle.manifest])
def test_operators_with_clashing_names(spark, operator):
    docs = table(spark)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert operator(docs).count() == operator(plain).count()
    operator(docs.limit(0)).count()


def test_conversations_with_clashing_names(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", None), (None, None, None, "x"), (1, 0, "user", "Hi.")]
    logs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = logs.select("*", *[F.lit("mine").alias(n) for n in NAMES + ["fault", "letter", "mark", "block", "codes", "turns", "a", "b", "c"]])
    assert repair.report(more, repair.damaged(more)).count() == 2
    assert chat.rendered(more).count() == chat.rendered(logs).count()
