"""Vector expressions on ``array<float|double>`` columns (pairs of columns).

These suit one pair per row. Scoring a corpus against queries goes through
``operators.knn``, which multiplies whole blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision; equals cosine on unit vectors."""
    return _total(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    )


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; NULL when either side is the zero vector."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(
        _total(
            F.zip_with(
                _col(a),
                _col(b),
                lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)),
            )
        )
    )


def scale(v: Column | str, factor: Column) -> Column:
    """Every element times ``factor``. The one-element array binds the factor
    to a lambda variable, so it is evaluated once per row and not per element."""
    return F.element_at(
        F.transform(
            F.array(factor.cast("double")),
            lambda f: F.transform(_col(v), lambda x: x.cast("double") * f),
        ),
        1,
    )


def l2_normalize(v: Column | str) -> Column:
    """Unit length; the zero vector stays as it is."""
    norm = l2_norm(v)
    return scale(v, F.coalesce(F.try_divide(F.lit(1.0), norm), F.lit(1.0)))
