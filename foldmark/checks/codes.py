"""Vector-quantisation code operators on the token and codebook views."""

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import codes as K
from .base import define, r6, registry

QUERIES, ORACLES, register = registry()

N, DIM = 16, 8

define("tk", """
SELECT t.vec_id, t.pos, CAST(t.token AS DOUBLE[]) AS token, f.sample_id FROM tokens t
JOIN fingerprints f ON f.id = t.vec_id""", ["tokens", "fingerprints"])
define("cb", "SELECT code, CAST(vec AS DOUBLE[]) AS vec FROM codebook", ["codebook"])
define("asg", """
SELECT vec_id, pos, sample_id, token, code, sq FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id, pos ORDER BY round(sq, 12), code) AS rn FROM (
    SELECT t.*, c.code, pow(list_distance(t.token, c.vec), 2) AS sq FROM tk t, cb c)) WHERE rn = 1""", ["tk", "cb"])
define("usage", """
SELECT CAST(c.code AS INTEGER) AS code, count(a.code) AS n FROM (SELECT unnest(range(0, 16)) AS code) c
LEFT JOIN asg a ON a.code = c.code GROUP BY 1""", ["asg"])


def _tokens(fx):
    who = fx.fingerprints.select(F.col("id").alias("vec_id"), "sample_id")
    return fx.tokens.join(who, "vec_id")


def _assigned(fx):
    return K.assign_codes(_tokens(fx), fx.codebook, ["vec_id", "pos"])


@register("vq_assign", "SELECT vec_id, CAST(pos AS INTEGER) AS pos, code, round(sq, 6) + 0.0E0 AS sq_dist FROM asg", ["asg"])
def vq_assign(fx):
    return _assigned(fx).select("vec_id", "pos", "code", r6("sq_dist"))


@register("vq_assign_blocks", "SELECT vec_id, CAST(pos AS INTEGER) AS pos, code, round(sq, 6) + 0.0E0 AS sq_dist FROM asg",
          ["asg"])
def vq_assign_blocks(fx):
    """The same through the block engine, as for a codebook too large to send."""
    return K.assign_codes(_tokens(fx), fx.codebook, ["vec_id", "pos"], max_sent=1).select(
        "vec_id", "pos", "code", r6("sq_dist"))


@register("commitment_error", "SELECT round(avg(sq)/8, 6) AS commitment FROM asg", ["asg"])
def commitment_error(fx):
    return K.commitment_error(_assigned(fx), DIM).select(r6("commitment"))


@register("code_usage", "SELECT code, n FROM usage", ["usage"])
def code_usage(fx):
    return K.code_usage(_assigned(fx), N)


@register("code_histogram", """
SELECT s.sample_id, CAST(c.code AS INTEGER) AS code, count(a.code) AS n,
  round(count(a.code)/(sum(count(a.code)) OVER (PARTITION BY s.sample_id) + 1e-8), 6) AS p
FROM (SELECT DISTINCT sample_id FROM asg) s CROSS JOIN (SELECT unnest(range(0, 16)) AS code) c
LEFT JOIN asg a ON a.sample_id = s.sample_id AND a.code = c.code GROUP BY 1,2""", ["asg"])
def code_histogram(fx):
    return K.histograms(_assigned(fx), n_codes=N).select("sample_id", "code", "n", r6("p"))


@register("tile_histogram", """
SELECT s.vec_id, CAST(c.code AS INTEGER) AS code, count(a.code) AS n, round(count(a.code)/8.0E0, 6) AS p
FROM (SELECT DISTINCT vec_id FROM asg) s CROSS JOIN (SELECT unnest(range(0, 16)) AS code) c
LEFT JOIN asg a ON a.vec_id = s.vec_id AND a.code = c.code GROUP BY 1,2""", ["asg"])
def tile_histogram(fx):
    return K.histograms(_assigned(fx), "vec_id", N, 0.0).select("vec_id", "code", "n", r6("p"))


@register("perplexity", """
SELECT round(exp(-sum(p*ln(p + 1e-8))), 6) AS perplexity FROM (SELECT n/(sum(n) OVER () + 1e-8) AS p FROM usage)""",
          ["usage"])
def perplexity(fx):
    return K.perplexity(K.code_usage(_assigned(fx), N)).select(r6("perplexity"))


@register("codebook_pareto", """
SELECT count(*) FILTER (n > 0) AS active_codes, count(*) AS n_codes, count(*) FILTER (c < 0.80) + 1 AS codes_for_80pct,
  count(*) FILTER (c < 0.95) + 1 AS codes_for_95pct, round(count(*) FILTER (n > 0)*1.0E0/count(*), 6) AS utilisation
FROM (SELECT n, sum(n) OVER (ORDER BY n DESC, code ROWS UNBOUNDED PRECEDING)*1.0E0/sum(n) OVER () AS c FROM usage)""",
          ["usage"])
def codebook_pareto(fx):
    out = K.pareto(K.code_usage(_assigned(fx), N))
    return out.select("active_codes", "n_codes", "codes_for_80pct", "codes_for_95pct", r6("utilisation"))


# the state before the update: count 1 and the code's own vector
define("sums", """
SELECT c.code, p.p, 0.995E0*1 + (1 - 0.995E0)*count(a.code) AS ema_count,
  0.995E0*any_value(c.vec[p.p]) + (1 - 0.995E0)*coalesce(sum(a.token[p.p]), 0) AS ema_sum
FROM cb c CROSS JOIN (SELECT unnest(range(1, 9)) AS p) p LEFT JOIN asg a ON a.code = c.code GROUP BY 1,2""", ["cb", "asg"])


def _state(fx):
    return fx.codebook.select("code", F.lit(1.0).alias("ema_count"), F.col("vec").alias("ema_sum"))


@register("ema_update", """
SELECT code, CAST(p - 1 AS INTEGER) AS dim, round(ema_count, 6) AS ema_count, round(ema_sum, 6) + 0.0E0 AS ema_sum,
  round(ema_sum/((ema_count + 1e-5)/(n + 16*1e-5)*n), 6) + 0.0E0 AS vec
FROM sums, (SELECT sum(ema_count) AS n FROM sums WHERE p = 1)""", ["sums"])
def ema_update(fx):
    out = K.ema_update(_state(fx), _assigned(fx), DIM)
    z = out.select("code", "ema_count", F.posexplode(F.arrays_zip("ema_sum", "vec")).alias("dim", "z"))
    return z.select("code", "dim", r6("ema_count"), (F.round("z.ema_sum", 6) + F.lit(0.0)).alias("ema_sum"),
                    (F.round("z.vec", 6) + F.lit(0.0)).alias("vec"))


@register("ema_shares", """
SELECT code, ema_count > 0.1 AS active, round(ema_count/(sum(ema_count) OVER () + 1e-8), 6) AS share
FROM sums WHERE p = 1""", ["sums"])
def ema_shares(fx):
    return K.ema_shares(K.ema_update(_state(fx), _assigned(fx), DIM)).select("code", "active", r6("share"))


# sampled tokens in md5 order; noise from pairs of md5 numbers
define("drawn", """
SELECT vec_id, pos, token, row_number() OVER (ORDER BY md5(concat('42:', vec_id, ':', pos)), vec_id, pos) - 1 AS k FROM tk
QUALIFY k < 16""", ["tk"])
_U = "(('0x' || substr(md5(concat('42:', code, ':', i, ':{}')), 1, 8))::BIGINT + 0.5E0)/4294967296.0E0"


@register("dead_code_revival", f"""
SELECT code, revived, CAST(i AS INTEGER) AS dim, round(CASE WHEN revived THEN token[i + 1]
    + 0.01E0*sqrt(-2.0E0*ln({_U.format(1)}))*cos(2*pi()*{_U.format(2)}) ELSE vec[i + 1] END, 6) + 0.0E0 AS v FROM (
  SELECT c.code, c.vec, u.n < 250 AS revived, d.token FROM cb c JOIN usage u USING (code)
  LEFT JOIN (SELECT code, row_number() OVER (ORDER BY code) - 1 AS k FROM usage WHERE n < 250) r ON r.code = c.code
  LEFT JOIN drawn d ON d.k = r.k % 16), (SELECT unnest(range(0, 8)) AS i)""", ["cb", "usage", "drawn"])
def dead_code_revival(fx):
    """Codes below a high threshold are replaced by sampled tokens with noise."""
    a = _assigned(fx)
    out = K.revive_dead_codes(fx.codebook, K.code_usage(a, N), fx.tokens, key=["vec_id", "pos"], threshold=250)
    return out.select("code", "revived", F.posexplode("vec").alias("dim", "v")).select("code", "revived", "dim", r6("v"))


@register("dead_codes", "SELECT code, n < 250 AS revived FROM usage", ["usage"])
def dead_codes(fx):
    out = K.revive_dead_codes(fx.codebook, K.code_usage(_assigned(fx), N), fx.tokens, key=["vec_id", "pos"], threshold=250)
    return out.select("code", "revived")


# weights of the linear map: row o, column i = ((o*8+i) % 7 - 3)/10, bias o/100
@register("fingerprint_project", """
SELECT m.vec_id, CAST(o.o AS INTEGER) AS out,
  round(sum(m.x*(((o.o*8 + m.p - 1) % 7) - 3)/10.0E0) + o.o/100.0E0, 6) + 0.0E0 AS value
FROM (SELECT a.vec_id, p.p, avg(c.vec[p.p]) AS x FROM asg a JOIN cb c USING (code)
  CROSS JOIN (SELECT unnest(range(1, 9)) AS p) p GROUP BY 1,2) m
CROSS JOIN (SELECT unnest(range(0, 4)) AS o) o GROUP BY 1, o.o""", ["asg", "cb"])
def fingerprint_project(fx):
    o = F.col("id")
    w = fx.spark.range(4).select(
        o.cast("int").alias("out"),
        F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: (((o * 8 + i) % 7) - 3) / F.lit(10.0)).alias("w"),
        (o / F.lit(100.0)).alias("bias"))
    pooled = K.mean_token(_assigned(fx), fx.codebook, ["vec_id"], DIM)
    out = K.linear_map(pooled, w).select("vec_id", F.posexplode("fingerprint").alias("out", "value"))
    return out.select("vec_id", "out", r6("value"))


# token score: its first value
@register("attention_pool", """
SELECT t.vec_id, CAST(p.p - 1 AS INTEGER) AS dim,
  round(sum(t.token[p.p]*exp(t.token[1]))/sum(exp(t.token[1])), 6) + 0.0E0 AS v
FROM tk t CROSS JOIN (SELECT unnest(range(1, 9)) AS p) p GROUP BY 1, p.p""", ["tk"])
def attention_pool(fx):
    t = fx.tokens.withColumn("score", F.get("token", F.lit(0)).cast("double"))
    out = K.attention_pool(t, ["vec_id"], DIM).select("vec_id", F.posexplode("pooled").alias("dim", "v"))
    return out.select("vec_id", "dim", r6("v"))


@register("token_topk", """
SELECT vec_id, CAST(pos AS INTEGER) AS pos, row_number() OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS slot FROM (
  SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY token[1] DESC, pos) AS r FROM tk) WHERE r <= 4""",
          ["tk"])
def token_topk(fx):
    t = fx.tokens.withColumn("score", F.get("token", F.lit(0)).cast("double"))
    return K.top_tokens(t, 4, ["vec_id"]).select("vec_id", "pos", F.col("slot").cast("long").alias("slot"))


@register("code_profile", """
SELECT code, round(avg(token[1]), 6) + 0.0E0 AS mean_boundary, count(*) AS n FROM asg GROUP BY 1""", ["asg"])
def code_profile(fx):
    a = _assigned(fx).withColumn("boundary", F.get("token", F.lit(0)).cast("double"))
    return K.code_profile(a, "boundary").select("code", r6("mean_boundary"), "n")


# token against its neighbour in the same tile
@register("reconstruction", """
SELECT round(avg(mse), 6) AS mse, round(avg(r), 6) + 0.0E0 AS pearson,
  round(avg(mse) + 0.5*(1 - avg(r)), 6) AS reconstruction FROM (
  SELECT pow(list_distance(a.token, b.token), 2)/8 AS mse,
    (SELECT sum((x - mx)*(y - my))/sqrt(sum(pow(x - mx, 2))*sum(pow(y - my, 2)) + 1e-8) FROM (
      SELECT unnest(a.token) AS x, unnest(b.token) AS y, list_avg(a.token) AS mx, list_avg(b.token) AS my)) AS r
  FROM tk a JOIN tk b ON b.vec_id = a.vec_id AND b.pos = a.pos + 1)""", ["tk"])
def reconstruction(fx):
    t = fx.tokens
    nxt = t.select("vec_id", (F.col("pos") - 1).alias("pos"), F.col("token").alias("other"))
    return K.reconstruction(t.join(nxt, ["vec_id", "pos"]), "token", "other").select(
        r6("mse"), r6("pearson"), r6("reconstruction"))


@register("concordance", """
SELECT a.vec_id, CAST(a.pos AS INTEGER) AS pos, round((SELECT sum((x - mx)*(y - my))/(sqrt(sum(pow(x - mx, 2))*sum(pow(y - my, 2))) + 1e-8)
  FROM (SELECT unnest(a.token) AS x, unnest(b.token) AS y, list_avg(a.token) AS mx, list_avg(b.token) AS my)), 6) + 0.0E0 AS r
FROM tk a JOIN tk b ON b.vec_id = a.vec_id AND b.pos = a.pos + 1""", ["tk"])
def concordance(fx):
    t = fx.tokens
    nxt = t.select("vec_id", (F.col("pos") - 1).alias("pos"), F.col("token").alias("other"))
    return t.join(nxt, ["vec_id", "pos"]).select(
        "vec_id", "pos", (F.round(V.concordance(F.col("token"), F.col("other")), 6) + F.lit(0.0)).alias("r"))


# three rounds from the codes of the fixture: each round assigns, updates the running means and divides
_FIT = """
WITH RECURSIVE {steps},
fit(r, code, n, s, v) AS (
  SELECT 0, code, 1.0E0, vec, vec FROM cb
  UNION ALL
  SELECT r + 1, code, n2, s2, list_transform(s2, lambda x: x/greatest(n2, 1e-5)) FROM (
    SELECT r, code, any_value(0.995E0*n) + (1 - 0.995E0)*count(token) AS n2,
      list_transform(range(1, 9), lambda i: 0.995E0*any_value(s)[i]
        + (1 - 0.995E0)*coalesce(list_sum(list_transform(list(token) FILTER (token IS NOT NULL), lambda t: t[i])), 0)) AS s2
    FROM (SELECT f.r, f.code, f.n, f.s, b.token FROM fit f LEFT JOIN (
        SELECT token, best.c AS code FROM (
          SELECT t.token, min(struct_pack(d := round(pow(list_distance(t.token, g.v), 2), 12), c := g.code)) AS best
          FROM tk t, fit g GROUP BY t.vec_id, t.pos, t.token)) b ON b.code = f.code WHERE f.r < 3)
    GROUP BY r, code))
SELECT code, CAST(i - 1 AS INTEGER) AS dim, round(v[i], 6) + 0.0E0 AS v FROM fit, (SELECT unnest(range(1, 9)) AS i) WHERE r = 3
"""


@register("codebook_fit", _FIT, ["cb", "tk"])
def codebook_fit(fx):
    """Three rounds from a given start; the seeded start is compared in the tests."""
    out = K.fit_codebook(fx.tokens, N, DIM, key=["vec_id", "pos"], start=fx.codebook, rounds=3)
    return out.select("code", F.posexplode("vec").alias("dim", "v")).select("code", "dim", r6("v"))


@register("codebook_seeded")
def codebook_seeded(fx):
    """Distance-weighted start and three rounds; held against the quantisation error in the tests."""
    out = K.fit_codebook(fx.tokens, 8, DIM, key=["vec_id", "pos"], rounds=3)
    return out.select("code", F.posexplode("vec").alias("dim", "v")).select("code", "dim", r6("v"))


@register("codebook_pca")
def codebook_pca(fx):
    from ..operators.evaluation import principal_components
    book = K.ema_update(_state(fx), _assigned(fx), DIM)
    out = principal_components(book.select("code", "vec"), 2, "vec")
    return out.select("code", F.get("pc", F.lit(0)).alias("pc1"), F.get("pc", F.lit(1)).alias("pc2"))
