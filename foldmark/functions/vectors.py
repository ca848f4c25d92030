"""Vector columns (array<float> stored, array<double> computed)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0), lambda s, x: s + x,
    )


def norm(v: Column) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x, F.sqrt)


def usable(v: Column) -> Column:
    """Whether a vector is there and its length is a finite number (no null, NaN or infinite element)."""
    return F.coalesce(norm(v) <= F.lit(1.7976931348623157e308), F.lit(False))


def unit(v: Column, eps: float = C.EPS) -> Column:
    """v / (|v| + eps). The length is summed once, in the fold's finishing step."""
    w = as_double(v)
    return F.aggregate(
        w, F.lit(0.0), lambda s, x: s + x * x,
        lambda s: F.transform(w, lambda x: x / (F.sqrt(s) + F.lit(eps))),
    )


def cosine(a: Column, b: Column, eps: float = C.EPS) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(eps)) * (norm(b) + F.lit(eps)))


def _pearson(a: Column, b: Column, combine) -> Column:
    """Raw-moment Pearson in one fold over the zipped pair."""
    zipped = F.zip_with(as_double(a), as_double(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("n", "x", "y", "xx", "yy", "xy")])

    def step(s, p):
        x, y = p["x"], p["y"]
        return F.struct(
            (s["n"] + 1.0).alias("n"), (s["x"] + x).alias("x"), (s["y"] + y).alias("y"),
            (s["xx"] + x * x).alias("xx"), (s["yy"] + y * y).alias("yy"), (s["xy"] + x * y).alias("xy"),
        )

    def done(s):
        sxy = s["xy"] - s["x"] * s["y"] / s["n"]
        sxx = F.greatest(s["xx"] - s["x"] * s["x"] / s["n"], F.lit(0.0))
        syy = F.greatest(s["yy"] - s["y"] * s["y"] / s["n"], F.lit(0.0))
        return combine(sxy, sxx, syy)

    return F.when(F.size(a) > 0, F.aggregate(zipped, zero, step, done))


def concordance(a: Column, b: Column) -> Column:
    """Pearson with 1e-8 added to the denominator; NULL for missing or empty input."""
    return _pearson(a, b, lambda xy, xx, yy: xy / (F.sqrt(xx * yy) + F.lit(C.EPS)))


def pearson_stable(a: Column, b: Column) -> Column:
    """Pearson with 1e-8 inside the square root (the reconstruction metric's form)."""
    return _pearson(a, b, lambda xy, xx, yy: xy / F.sqrt(xx * yy + F.lit(C.EPS)))


def mean_squared_difference(a: Column, b: Column) -> Column:
    sq = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(sq, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def transpose_square(matrix: Column, n: int) -> Column:
    """Row-major n x n matrix, transposed by index permutation."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n * n - 1)),
        lambda i: F.element_at(matrix, (i % n) * n + F.floor(i / n).cast("int") + 1),
    )


def sum_vectors(v: Column, dim: int) -> Column:
    """Element-wise sum as an aggregate: one partial sum per position, no explode."""
    return F.array(*[F.sum(F.get(v, F.lit(i)).cast("double")) for i in range(dim)])


def mean_vectors(v: Column, dim: int) -> Column:
    """Element-wise mean as an aggregate."""
    return F.array(*[F.avg(F.get(v, F.lit(i)).cast("double")) for i in range(dim)])
