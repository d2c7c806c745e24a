"""Arithmetic with pinned edge cases (ANSI mode stays on)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

INF = float("inf")
NAN = float("nan")
FLOAT32_MAX = 3.4028234663852886e38


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def fdiv(a, b) -> Column:
    """IEEE division: x/0 is ±inf and 0/0 is NaN instead of an ANSI error."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    at_zero = (
        F.when(a.isNull() | F.isnan(a) | (a == 0), F.when(a.isNotNull(), F.lit(NAN)))
        .when(a > 0, F.lit(INF))
        .otherwise(F.lit(-INF))
    )
    return F.when(b == 0, at_zero).otherwise(a / b)


def safe_divide(a, b, default: float = 0.0) -> Column:
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b != 0, a / b).otherwise(F.lit(float(default)))


def reciprocal_or_zero(b) -> Column:
    b = _c(b).cast("double")
    return F.when(b == 0, F.lit(0.0)).otherwise(F.lit(1.0) / b)


def finite32(x) -> Column:
    """±inf becomes the largest float32, then NaN and null become zero."""
    x = _c(x)
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(0.0))
        .when((x == F.lit(INF)) | (x == F.lit(-INF)), F.lit(FLOAT32_MAX))
        .otherwise(x)
    )


def nan_to_null(x) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def isclose(a, b, rel: float = 1e-9, absolute: float = 1e-12) -> Column:
    a, b = _c(a), _c(b)
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def uniform(*parts) -> Column:
    """Counter-based uniform in [0, 1): depends on its key only, so it is the
    same for any partitioning, retry or engine. 52 bits, so that every rank of
    a table up to 4e15 rows can be drawn. Strings are literals."""
    text = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)


def normal(*parts) -> Column:
    """Standard normal from two counter-based uniforms (Box-Muller)."""
    u1 = uniform("n1", *parts)
    u2 = uniform("n2", *parts)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(6.283185307179586) * u2)


def add_all(cols) -> Column:
    """Left-to-right sum, so the rounding order is fixed."""
    return reduce(lambda x, y: x + y, cols)


def equal_width_bin(x, lo, hi, n: int) -> Column:
    """Zero-based bin of ``n`` equal bins on [lo, hi]; the last bin is closed."""
    x, lo, hi = _c(x), _c(lo), _c(hi)
    return F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((x - lo) * F.lit(float(n)) / (hi - lo))))
    ).cast("int")
