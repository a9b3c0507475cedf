"""Dense-vector expressions on ARRAY<FLOAT|DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: keeps the cosine finite for zero vectors.
EPSILON = 1e-10


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine with EPSILON added to each norm; stored norms are used when given."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    return dot(a, b) / ((na + F.lit(EPSILON)) * (nb + F.lit(EPSILON)))


def l2_normalize(v: Column) -> Column:
    """Unit-length copy; a zero vector is returned unchanged."""
    length = F.array(F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0)))
    # Binding the norm as a lambda variable computes it once per vector.
    return F.get(F.transform(length, lambda n: F.transform(v, lambda x: (x / n).cast("float"))), F.lit(0))


def has_dim(v: Column, dim: int) -> Column:
    """True for a vector of exactly ``dim`` non-null elements."""
    ok = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull())
    return F.coalesce(v.isNotNull() & ok, F.lit(False))
