"""Vector-quantisation codes: assignment, usage, codebook refresh, projections.

A codebook is a model parameter of fixed size. It is sent to the executors
only after its row count has been checked; larger tables use the block engine.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import vectors as V
from . import blocks
from ..sources.scratch import written
from .tables import first_in_hash_order

MAX_SENT_CODES = 16_384


def assign_codes(tokens: DataFrame, codebook: DataFrame, key, token: str = "token",
                 max_sent: int = MAX_SENT_CODES) -> DataFrame:
    """Nearest code by squared distance, lowest code on ties: columns ``code`` and ``sq_dist``.

    Every row gets its own code, whatever its ``key``; a row without a token has none. Both ways of
    working it out score and break ties alike.
    """
    rows = codebook.select("code", "vec").limit(max_sent + 1).collect()
    if len(rows) > max_sent:
        return _assign_by_blocks(tokens, codebook, token)
    rows.sort(key=lambda r: r["code"])
    codes = np.array([r["code"] for r in rows], dtype=np.int32)
    vecs = np.array([r["vec"] for r in rows], dtype=np.float64)
    sent = tokens.sparkSession.sparkContext.broadcast((codes, vecs, (vecs * vecs).sum(axis=1)))
    schema = StructType(tokens.schema.fields + [StructField("code", IntegerType()), StructField("sq_dist", DoubleType())])
    arrow = to_arrow_schema(schema)

    def nearest(batches):
        code, vec, half = sent.value
        for b in batches:
            there = np.flatnonzero(np.asarray(b.column(b.schema.get_field_index(token)).is_valid()))
            best, dist = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            t = blocks.matrix_of(pa.table(b).take(pa.array(there)), token) if len(there) else np.zeros((0, 1))
            for lo, hi in blocks.row_chunks(len(t), len(code)):
                s = 2.0 * (t[lo:hi] @ vec.T) - half - (t[lo:hi] * t[lo:hi]).sum(axis=1)[:, None]
                i, j, v = blocks.best_in_rows(s, 1)
                best[there[lo:hi][i]], dist[there[lo:hi][i]] = j, -v
            none = best < 0
            yield pa.RecordBatch.from_arrays(
                b.columns + [pa.array(code[best], mask=none), pa.array(dist, mask=none)], schema=arrow)

    return tokens.mapInArrow(nearest, schema)


def _assign_by_blocks(tokens, codebook, token):
    """The code belongs to the token's value: distinct values are scored and the result joined back to the rows."""
    side = codebook.select("code", F.col("vec").alias(token))
    values = tokens.where(F.col(token).isNotNull()).select(F.col(token).alias("_value")).distinct()
    found = blocks.top_matches(values.withColumn(token, F.col("_value")), side, 1, vector=token, q_key=["_value"],
                               r_key="code", metric="l2")
    got = found.select("_value", F.col("ref_code").cast("int").alias("code"), (-F.col("score")).alias("sq_dist"))
    return tokens.join(got, F.col(token) == F.col("_value"), "left").drop("_value")


def commitment_error(assigned: DataFrame, dim: int) -> DataFrame:
    """Mean squared difference between token values and their code's values."""
    return assigned.agg((F.avg("sq_dist") / F.lit(dim)).alias("commitment"))


def code_usage(assigned: DataFrame, n_codes: int = C.N_CODES) -> DataFrame:
    """Uses of every code 0..n_codes-1, unused ones included."""
    used = assigned.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    every = assigned.sparkSession.range(n_codes).select(F.col("id").cast("int").alias("code"))
    return every.join(used, "code", "left").na.fill(0, ["n"])


def histograms(assigned: DataFrame, by: str = "sample_id", n_codes: int = C.N_CODES, eps: float = C.EPS) -> DataFrame:
    """Share of every code per sample (long form, zero rows included)."""
    n = assigned.groupBy(by, "code").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(by).agg(F.sum("n").alias("_total"))
    every = total.select(by, "_total", F.explode(F.sequence(F.lit(0), F.lit(n_codes - 1))).alias("code"))
    return (every.join(n, [by, "code"], "left").na.fill(0, ["n"])
            .select(by, "code", "n", (F.col("n") / (F.col("_total") + F.lit(eps))).alias("p")))


def stored_histograms(hist: DataFrame, by: str = "sample_id") -> DataFrame:
    """One float array per sample, in code order."""
    rows = F.sort_array(F.collect_list(F.struct("code", "p")))
    return hist.groupBy(by).agg(F.transform(rows, lambda r: r["p"].cast("float")).alias("code_histogram"))


def perplexity(usage: DataFrame) -> DataFrame:
    total = usage.agg(F.sum("n").alias("t")).scalar()
    p = F.col("n") / (total + F.lit(C.EPS))
    return usage.select(p.alias("p")).agg(F.exp(-F.sum(F.col("p") * F.log(F.col("p") + F.lit(C.EPS)))).alias("perplexity"))


def pareto(usage: DataFrame) -> DataFrame:
    """Active codes, utilisation and the number of codes that carry 80 and 95 % of the uses.

    The window runs over the codebook, whose size is fixed.
    """
    order = Window.orderBy(F.desc("n"), F.asc("code")).rowsBetween(Window.unboundedPreceding, 0)
    cum = usage.withColumn("_c", F.sum("n").over(order)).withColumn("_t", F.sum("n").over(Window.partitionBy()))
    share = F.col("_c") / F.col("_t")
    return (cum.select("n", share.alias("c")).agg(
        F.count_if(F.col("n") > 0).alias("active_codes"), F.count(F.lit(1)).alias("n_codes"),
        (F.count_if(F.col("c") < 0.80) + 1).alias("codes_for_80pct"),
        (F.count_if(F.col("c") < 0.95) + 1).alias("codes_for_95pct"))
        .withColumn("utilisation", F.col("active_codes") / F.col("n_codes")))


def ema_shares(state: DataFrame) -> DataFrame:
    """Share of every code by its running count, active above 0.1."""
    total = state.agg(F.sum("ema_count").alias("t")).scalar()
    return state.select("code", (F.col("ema_count") > 0.1).alias("active"),
                        (F.col("ema_count") / (total + F.lit(C.EPS))).alias("share"))


def batch_statistics(assigned: DataFrame, dim: int, token: str = "token") -> DataFrame:
    """Count and vector sum of the tokens per code."""
    return assigned.groupBy("code").agg(F.count(F.lit(1)).cast("double").alias("cnt"),
                                        V.sum_vectors(F.col(token), dim).alias("total"))


def ema_update(state: DataFrame, assigned: DataFrame, dim: int, gamma: float = C.EMA_GAMMA,
               token: str = "token") -> DataFrame:
    """Codebook after one batch: running count and sum, and the Laplace-smoothed vector.

    ``state`` has code, ema_count, ema_sum for every code.
    """
    s = state.select("code", "ema_count", V.as_double(F.col("ema_sum")).alias("ema_sum")).join(
        batch_statistics(assigned, dim, token), "code", "left")
    keep, add = F.lit(gamma), F.lit(1.0 - gamma)
    zero = F.array_repeat(F.lit(0.0), dim)
    moved = s.select(
        "code", (keep * F.col("ema_count") + add * F.coalesce("cnt", F.lit(0.0))).alias("ema_count"),
        F.zip_with("ema_sum", F.coalesce("total", zero), lambda a, b: keep * a + add * b).alias("ema_sum"))
    whole = Window.partitionBy()  # the codebook only
    n, k = F.sum("ema_count").over(whole), F.count(F.lit(1)).over(whole)
    smooth = moved.withColumn("_s", (F.col("ema_count") + 1e-5) / (n + k * 1e-5) * n)
    return smooth.select("code", "ema_count", "ema_sum",
                         F.transform("ema_sum", lambda x: x / F.col("_s")).alias("vec"))


def _uniform(*parts):
    """Repeatable number in (0, 1) from the md5 of the parts, the same in every engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


def revive_dead_codes(codebook: DataFrame, usage: DataFrame, tokens: DataFrame, *, key, threshold: int = C.DEAD_THRESHOLD,
                      noise: float = 0.01, seed: int = C.SEED, token: str = "token") -> DataFrame:
    """Codes used less than the threshold take the value of a sampled token plus noise.

    As many tokens as there are codes are taken in hash order; a dead code gets
    the one of its rank, repeating them when tokens are fewer. The same input
    gives the same codebook on every run.
    """
    drawn = first_in_hash_order(tokens.select(*key, F.col(token).alias("_t")), codebook.count(), key, seed).select("_k", "_t")
    dead = (codebook.join(usage.where(F.col("n") < threshold).select("code"), "code", "left_semi")
            .select("code", (F.row_number().over(Window.orderBy("code")) - 1).alias("_rank")))
    have = drawn.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).scalar()
    given = dead.withColumn("_k", F.pmod("_rank", have).cast("int")).join(drawn, "_k").select("code", "_t")
    gauss = lambda i: (F.sqrt(-2.0 * F.log(_uniform(F.lit(seed), F.col("code"), i, F.lit(1))))
                       * F.cos(F.lit(2 * np.pi) * _uniform(F.lit(seed), F.col("code"), i, F.lit(2))))
    fresh = F.transform(V.as_double(F.col("_t")), lambda x, i: x + F.lit(noise) * gauss(i))
    return (codebook.join(given, "code", "left")
            .select("code", F.coalesce(fresh, V.as_double(F.col("vec"))).alias("vec"),
                    F.col("_t").isNotNull().alias("revived")))


def mean_token(assigned: DataFrame, codebook: DataFrame, by, dim: int) -> DataFrame:
    """Mean quantised token per tile, from code counts: one row per (tile, code) reaches the codebook join."""
    n = assigned.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("_n"))
    j = n.join(codebook.select("code", V.as_double(F.col("vec")).alias("vec")), "code")
    total = F.sum("_n")
    return j.groupBy(*by).agg(F.array(*[
        F.sum(F.get("vec", F.lit(i)) * F.col("_n")) / total for i in range(dim)]).alias("pooled"))


def linear_map(df: DataFrame, weights: DataFrame, vector: str = "pooled", out: str = "fingerprint") -> DataFrame:
    """Vector times weight matrix plus bias; ``weights`` has out, w (array) and bias.

    The matrix is a model parameter; it is attached as one row and applied by
    array functions.
    """
    m = weights.agg(F.sort_array(F.collect_list(F.struct("out", V.as_double(F.col("w")).alias("w"), "bias"))).alias("_m"))
    wide = df.withColumn("_m", m.scalar())
    return wide.withColumn(out, F.transform("_m", lambda r: V.dot(r["w"], F.col(vector)) + r["bias"])).drop("_m")


def attention_pool(tokens: DataFrame, by, dim: int, token: str = "token", score: str = "score") -> DataFrame:
    """Softmax of given token scores per tile, then the weighted token sum."""
    top = tokens.groupBy(*by).agg(F.max(score).alias("_top"))
    e = tokens.join(top, list(by)).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    return e.groupBy(*by).agg(F.array(*[
        F.sum(F.get(token, F.lit(i)).cast("double") * F.col("_e")) / F.sum("_e") for i in range(dim)]).alias("pooled"))


def top_tokens(tokens: DataFrame, keep: int, by, score: str = "score") -> DataFrame:
    """Tokens with the ``keep`` best scores per tile, renumbered in position order."""
    best = Window.partitionBy(*by).orderBy(F.desc(score), F.asc("pos"))
    place = Window.partitionBy(*by).orderBy("pos")
    return (tokens.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep).drop("_r")
            .withColumn("slot", F.row_number().over(place) - 1))


def seed_codebook(tokens: DataFrame, n_codes: int, *, key, rounds: int = 5, oversample: int = 2, seed: int = C.SEED,
                  token: str = "token") -> DataFrame:
    """Starting codebook (code, vec) spread over the tokens by distance-weighted rounds.

    The first candidate is the token of least hash. A round keeps the ``oversample * n_codes`` tokens of least -ln(u) / d², where u
    comes from the hash of key and round and d is the distance to the nearest candidate: a sample without replacement in
    proportion to d². Candidates, at most ``1 + rounds * oversample * n_codes`` rows, are weighted by the tokens nearest to them and thinned to
    ``n_codes`` the same way in one task. Fewer distinct tokens than codes give fewer codes.
    """
    real = tokens.where(F.col(token).isNotNull()).select(*key, V.as_double(F.col(token)).alias("t"))

    def least(df, order, n):
        return df.orderBy(order, *key).limit(n).select(F.col("t").alias("vec"))

    chosen = least(real, _uniform(F.lit(seed), F.lit(0), *[F.col(k) for k in key]), 1)
    for r in range(1, rounds + 1):
        chosen = _numbered(written(chosen, "candidates"))
        far = assign_codes(real, chosen, key, "t").where(F.col("sq_dist") > 0)
        wait = -F.log(_uniform(F.lit(seed), F.lit(r), *[F.col(k) for k in key])) / F.col("sq_dist")
        chosen = chosen.select("vec").unionByName(least(far, wait, oversample * n_codes)).distinct()
    chosen = _numbered(written(chosen, "candidates"))
    weights = assign_codes(real, chosen, key, "t").groupBy("code").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    weighted = chosen.join(weights, "code").select("code", "vec", "weight")

    def thinned(t):
        t = t.sort_by("code")
        x, w = blocks.matrix_of(t, "vec"), t["weight"].to_numpy()
        take, near = [int(w.argmax())], ((x - x[w.argmax()]) ** 2).sum(axis=1)
        while len(take) < n_codes and near.max() > 0:
            take.append(int((near * w).argmax()))
            near = np.minimum(near, ((x - x[take[-1]]) ** 2).sum(axis=1))
        vec = t["vec"].combine_chunks().take(pa.array(take))
        return pa.table({"code": pa.array(np.arange(len(take)), pa.int32()), "vec": vec})

    return weighted.withColumn("together", F.lit(0)).groupBy("together").applyInArrow(thinned, "code int, vec array<double>")


def _numbered(candidates: DataFrame) -> DataFrame:
    """Candidates with codes in the order of their values (a bounded number of rows)."""
    return candidates.select((F.row_number().over(Window.orderBy("vec")) - 1).cast("int").alias("code"), "vec")


def fit_codebook(tokens: DataFrame, n_codes: int, dim: int, *, key, start: DataFrame | None = None, tolerance: float = 1e-4,
                 rounds: int = 100, seed: int = C.SEED, gamma: float = C.EMA_GAMMA, token: str = "token") -> DataFrame:
    """Codebook without gradients: a start, then assignment and running-mean rounds until no value moves further.

    ``start`` (code, vec) is ``seed_codebook``'s unless given; each of its codes begins with count 1. The state of a round is a stored table, and
    what reaches the driver is how far the round moved. ``converged`` says whether the last round moved every value by less than ``tolerance``.
    """
    book = start if start is not None else seed_codebook(tokens, n_codes, key=key, seed=seed, token=token)
    state = written(book.select("code", F.lit(1.0).alias("ema_count"), V.as_double(F.col("vec")).alias("ema_sum"),
                                V.as_double(F.col("vec")).alias("vec")), "codebook")
    converged = False
    for _ in range(rounds):
        new = written(ema_update(state, assign_codes(tokens, state.select("code", "vec"), key, token), dim, gamma, token).select(
            "code", "ema_count", "ema_sum",
            F.transform("ema_sum", lambda x: x / F.greatest(F.col("ema_count"), F.lit(1e-5))).alias("vec")), "codebook")
        before = state.select("code", F.col("vec").alias("old"))
        move = F.array_max(F.zip_with("vec", "old", lambda a, b: F.abs(a - b)))
        moved = new.join(before, "code").agg(F.max(move)).first()[0]
        state, converged = new, moved is None or moved < tolerance
        if converged:
            break
    return state.select("code", "vec", F.lit(converged).alias("converged"))


def code_profile(assigned: DataFrame, value: str) -> DataFrame:
    """Average of a per-tile value over the tiles assigned to each code."""
    return assigned.groupBy("code").agg(F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("n"))


def reconstruction(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean squared error + 0.5 (1 - mean Pearson) between two tile columns."""
    return (pairs.select(V.mean_squared_difference(F.col(a), F.col(b)).alias("mse"),
                         V.pearson_stable(F.col(a), F.col(b)).alias("r"))
            .agg(F.avg("mse").alias("mse"), F.avg("r").alias("pearson"))
            .withColumn("reconstruction", F.col("mse") + 0.5 * (1.0 - F.col("pearson"))))
