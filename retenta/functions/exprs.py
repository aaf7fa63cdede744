"""Column-expression helpers (all JVM-side, whole-stage-codegen friendly).

Rounding follows PostgreSQL's NUMERIC ROUND: half away from zero on the exact
ratio. Integer arithmetic decides the rounding so that no binary double or
intermediate decimal scale can round a value twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio_round(num, den, scale: int = 2) -> Column:
    """round(num / den, scale), half away from zero, for integral num and den > 0.

    q = floor((2*m*|num| + den) / (2*den)) with m = 10**scale is the exact
    rounded value times m; the result is sign(num) * q / m as DOUBLE. NULL when
    den is 0 or NULL (PostgreSQL would raise; ANSI Spark raises too).
    """
    num, den = _c(num).cast("long"), _c(den).cast("long")
    m = 10 ** scale
    big = "decimal(38,0)"
    n = F.abs(num).cast(big) * (2 * m) + den.cast(big)
    d = den.cast(big) * 2
    # n - n % d is an exact multiple of d: the decimal quotient is the exact integer floor
    q = ((n - n % d) / d).cast(big)
    return F.when(den != 0, F.signum(num) * q.cast("double") / F.lit(float(m)))


def pct(part, whole) -> Column:
    """ROUND(100.0 * part / whole, 2) for integer counts."""
    return ratio_round(_c(part).cast("long") * 100, whole, 2)


def money_avg(total, n) -> Column:
    """ROUND(total / n, 2) for a 2-dp money total, exactly; DOUBLE result."""
    cents = (_c(total) * 100).cast("long")
    return ratio_round(cents, n, 0) / F.lit(100.0)


def money(x) -> Column:
    """A 2-dp decimal money value as DOUBLE (what a client library reads)."""
    return _c(x).cast("double")


def flag(cond) -> Column:
    """CASE WHEN cond THEN 1 ELSE 0 END; a NULL condition gives 0."""
    return F.coalesce(_c(cond), F.lit(False)).cast("int")


def null_flag(x) -> Column:
    """isnull().astype(int)."""
    return _c(x).isNull().cast("int")


def safe_div(a, b) -> Column:
    """a / NULLIF(b, 0)."""
    return _c(a) / F.nullif(_c(b), F.lit(0))


def count_where(cond) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) as LONG; 0 on an empty group of rows."""
    return F.coalesce(F.sum(flag(cond).cast("long")), F.lit(0).cast("long"))
