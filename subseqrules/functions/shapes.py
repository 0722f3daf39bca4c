"""Scalar and array functions: normalisation, alignment errors, predictors and fits as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def span(arr: Column) -> Column:
    return F.array_max(arr) - F.array_min(arr)


def zeros(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.lit(0.0))


def bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body over a struct of `values`, each computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def normalize_by(arr: Column, s0: Column) -> Column:
    """(x - s0) / range; flat arrays give zeros."""
    body = lambda e: F.when(e["r"] == 0, zeros(e["x"])).otherwise(F.transform(e["x"], lambda x: (x - e["s"]) / e["r"]))
    return bound({"x": arr, "s": s0, "r": span(arr)}, body)


def normalize_shift_scale(arr: Column, scale: Column | float = 1.0) -> Column:
    """(x - first) / range * scale; flat arrays give zeros."""
    body = lambda e: F.when(e["r"] == 0, zeros(e["x"])).otherwise(F.transform(e["x"], lambda x: (x - e["s"]) / e["r"] * e["k"]))
    return bound({"x": arr, "s": F.get(arr, F.lit(0)), "r": span(arr), "k": F.lit(scale) if isinstance(scale, (int, float)) else scale}, body)


def local_align_error(a: Column, b: Column, window: int) -> Column:
    """e[i] = the larger of the smallest |a[j] - b[i]| and the smallest |a[i] - b[j]| for j within the window, over the shorter length."""
    size = F.least(F.size(a), F.size(b))

    def errors(e: Column) -> Column:
        a, b, n = e["a"], e["b"], e["n"]
        w = F.greatest(F.lit(0), F.least(F.lit(window), n - 1))

        def near(x: Column, i: Column) -> Column:
            lo = F.greatest(F.lit(0), i - w)
            return F.slice(x, lo + 1, F.least(n - 1, i + w) - lo + 1)

        def at(i: Column) -> Column:
            return bound({"p": F.get(a, i), "q": F.get(b, i)}, lambda v: F.greatest(
                F.array_min(F.transform(near(a, i), lambda x: F.abs(x - v["q"]))), F.array_min(F.transform(near(b, i), lambda x: F.abs(v["p"] - x)))))

        return F.when(n == 0, F.slice(a, 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), at))

    return bound({"a": a, "b": b, "n": size}, errors)


def local_align_error_norm(a: Column, b: Column, window: int) -> Column:
    """The same after both are shifted by a's first value and divided by their own range."""
    first = F.get(a, F.lit(0))
    return local_align_error(normalize_by(a, first), normalize_by(b, first), window)


def error_aggregate(errors: Column, kind: str = "max") -> Column:
    """Largest or mean error; infinite when there is none."""
    some = F.array_max(errors) if kind == "max" else F.aggregate(errors, F.lit(0.0), lambda s, x: s + x) / F.size(errors)
    return F.when(F.size(errors) == 0, F.lit(float("inf"))).otherwise(some)


def predict_linear(x: Column, a: Column, b: Column) -> Column:
    return a * x + b


def predict_poly(x: Column, coef: Column) -> Column:
    """Sum of coef[i] x^i, by Horner from the highest."""
    return F.aggregate(F.reverse(coef), F.lit(0.0), lambda s, c: s * x + c)


def predict_trig(x: Column, a, b, c, d) -> Column:
    return a * F.sin(b * x + c) + d


def predict_log(x: Column, a, b, c, d) -> Column:
    inner = b * x + c
    return F.when(inner <= 0, d).otherwise(a * F.ln(inner) + d)


def predict_exp(x: Column, a, b, c, d) -> Column:
    return a * F.exp(b * x + c) + d


def predict_inverse(x: Column, a, b, c) -> Column:
    den = a * x + b
    return F.when(F.abs(den) < 1e-12, c).otherwise(1 / den + c)


def predict_piecewise(x: Column, breaks: Column, slopes: Column, intercepts: Column) -> Column:
    """The line of the segment [breaks[j], breaks[j + 1]) that holds x; the last break, within 1e-5, belongs to the last; else 0."""
    n = F.size(slopes)
    j = F.size(F.filter(F.slice(breaks, 1, F.greatest(n, F.lit(0))), lambda b: b <= x)) - 1
    last = F.element_at(breaks, -1)
    j = F.when((x >= last) & (x <= last + 1e-5), n - 1).otherwise(F.when((x < last) & (j >= 0), j))
    return F.when(j.isNull(), 0.0).otherwise(F.get(slopes, j) * x + F.get(intercepts, j))


def predict_shape(kind: Column, x: Column, coef: Column, breaks: Column, slopes: Column, intercepts: Column) -> Column:
    """The shape function of the given kind at x."""
    c = [F.get(coef, F.lit(i)) for i in range(4)]
    return (
        F.when(kind == "piecewise", predict_piecewise(x, breaks, slopes, intercepts))
        .when(kind == "linear", predict_linear(x, c[0], c[1]))
        .when(kind == "poly", predict_poly(x, coef))
        .when(kind == "trig", predict_trig(x, *c))
        .when(kind == "log", predict_log(x, *c))
        .when(kind == "exp", predict_exp(x, *c))
        .when(kind == "inverse", predict_inverse(x, *c[:3]))
    )


def linear_combine(coef: Column, x: Column) -> Column:
    """coef[0] + sum of coef[i + 1] x[i]."""
    terms = F.zip_with(F.slice(coef, 2, F.greatest(F.size(coef) - 1, F.lit(0))), x, lambda c, v: c * v)
    return F.aggregate(terms, F.get(coef, F.lit(0)), lambda s, v: s + v)


def slope_penalty(err: Column, lam: Column, delta: Column, gamma: Column, penalty: float) -> Column:
    """err * max(r, 1 / r) ^ penalty with r = (lam / delta) / gamma; as it is where lam * gamma is 0."""
    r = lam / delta / gamma
    return F.when(lam * gamma == 0, err).otherwise(err * F.pow(F.greatest(r, 1 / r), F.lit(penalty)))


def min_samples(n_lhs: Column, t1_only: bool = False) -> Column:
    return n_lhs + 1 if t1_only else F.when(n_lhs == 1, 4).otherwise(3 * n_lhs + 1)


def label_token(x: Column) -> Column:
    """Whole numbers as such, else the text without characters that paths don't take; NULL if nothing is left."""
    number = x.try_cast("double")
    text = F.when(number == F.floor(number), F.floor(number).cast("long").cast("string")).otherwise(x.cast("string"))
    return F.nullif(F.regexp_replace(text, "[^A-Za-z0-9._-]", ""), F.lit(""))


def choose(n: Column, k: int) -> Column:
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


def max_turns(confidence: float, degree: int, score: Column, m1: Column, m2: Column, most: int) -> Column:
    """Draws needed so that one is all right with the given confidence, at least 500 and at most `most`."""
    p = choose(score, degree) / (choose(m1, degree) * m2)
    n = F.when(p >= 1, 0.0).when(p <= 0, float(most)).otherwise(F.rint(F.ln(F.lit(1 - confidence)) / F.ln(1 - p)))
    return F.greatest(F.lit(500), F.least(F.lit(most), n)).cast("int")


def linear_fit(rows: DataFrame, keys: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """(keys, slope, intercept) by least squares; where x hardly varies slope 0 and the mean."""
    flat = F.coalesce(F.stddev_pop(x), F.lit(0.0)) < 1e-10
    return rows.groupBy(*keys).agg(F.when(flat, 0.0).otherwise(F.regr_slope(y, x)).alias("slope"), F.when(flat, F.avg(y)).otherwise(F.regr_intercept(y, x)).alias("intercept"))


def sets_intersect(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def longest_element(rows: DataFrame, keys: list[str], arr: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(arr, F.size(arr)).alias(arr))
