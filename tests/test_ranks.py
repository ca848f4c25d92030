import random

from pyspark.sql import functions as F

from foldmark.operators import ranks


def test_numbered_with_a_hot_group_nulls_and_clashing_names(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *range(400)]), k, "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, _at long, _size string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.numbered(df, ["v", "_at"], ["g"], "row", total="n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want.update({r[2]: (k, len(own)) for k, r in enumerate(own)})
    assert {r["_at"]: (r["row"], r["n"]) for r in got} == want and len(got) == 3000
    one = ranks.numbered(df, [F.col("_at").desc()], (), "row").collect()
    assert all(r["row"] == 2999 - r["_at"] for r in one)
    assert ranks.numbered(df.limit(0), ["v"], ["g"], "row", total="n").count() == 0


def test_midranks_of_close_and_tied_scores(spark):
    rnd = random.Random(5)
    scores = [0.95 + rnd.randrange(300) / 6000 for _ in range(2000)] + [0.97] * 900 + [None] * 3
    df = spark.createDataFrame(list(enumerate(scores)), "id long, s double").repartition(5)
    got = {r["id"]: r["rank"] for r in ranks.ranked(df, "s").collect()}
    order = sorted(s for s in scores if s is not None)
    first, last = {}, {}
    for k, s in enumerate(order, 1):
        first.setdefault(s, k)
        last[s] = k
    assert got == {i: None if s is None else (first[s] + last[s]) / 2 for i, s in enumerate(scores)}
