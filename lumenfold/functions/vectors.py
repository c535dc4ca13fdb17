"""Vector functions on array<float> or array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .peaks import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Divided by its norm, at least 1e-12; a zero vector stays zero."""
    return let(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def all_finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def cast(v: Column, single: bool = True) -> Column:
    return v.cast("array<float>" if single else "array<double>")


def dense_gb(rows: int, size: int, bytes_each: int = 4) -> float:
    return rows * size * bytes_each / 1024**3


def summary(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Share of finite rows; least, mean and largest norm."""
    v = F.col(column)
    ok = all_finite(v)
    n = F.when(ok, norm(v))
    return df.agg(F.count("*").alias("n_rows"), F.avg(ok.cast("double")).alias("finite_ratio"), F.min(n).alias("min_norm"), F.avg(n).alias("mean_norm"), F.max(n).alias("max_norm"))


def require_usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Raises on NaN, infinity or an all-zero matrix; gives df."""
    bad, top = df.agg(F.sum((~all_finite(F.col(column))).cast("int")), F.max(norm(F.col(column)))).first()
    if bad or not top:
        raise ValueError(f"{bad or 0} rows are not finite" if bad else "all vectors are zero")
    return df
