"""Column expressions that several operators share; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_number(*parts) -> Column:
    """The first 32 bits of the MD5 of the parts joined by "|", as a long: a hash that other engines can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 8), 16, 10).cast("long")


def md5_order(*parts) -> Column:
    """A hash to order rows by, the same for one seed."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    """v over its L2 norm; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    """With the exponent held within 30."""
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def text_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)


def lorentz_exp(v: Column) -> Column:
    """From the tangent space at the origin onto the hyperboloid: (cosh r, sinh r v / r)."""
    r = norm(v)
    return F.concat(F.array(F.cosh(r)), F.transform(v, lambda x: F.when(r > 0, F.sinh(r) * x.cast("double") / r).otherwise(F.lit(0.0))))


def lorentz_log(p: Column) -> Column:
    """Back from the hyperboloid to the tangent space at the origin."""
    tail = F.slice(p, F.lit(2), F.size(p) - 1)
    r, s = F.acosh(F.greatest(p[0], F.lit(1.0))), norm(tail)
    return F.transform(tail, lambda x: F.when(s > 0, r * x / s).otherwise(F.lit(0.0)))
