"""Numbers that are compared, and statistics that are NULL where they aren't defined."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column) -> Column:
    return F.round(x, 6)


def half_up(x: Column, digits: int) -> Column:
    """Half-up rounding in doubles, step by step, so that ``half_up_sql`` gives the same value on a rounding edge too."""
    return F.floor(x * float(10**digits) + F.lit(0.5)) / F.lit(float(10**digits))


def half_up_text(x: str, digits: int) -> str:
    """``half_up`` as Spark SQL."""
    return f"floor(({x}) * {float(10**digits)}D + 0.5D) / {float(10**digits)}D"


def half_up_sql(x: str, digits: int) -> str:
    return f"floor(({x}) * {float(10**digits)}::DOUBLE + 0.5::DOUBLE) / {float(10**digits)}::DOUBLE"


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation over the rows with both values; NULL without variance (``F.corr`` divides by zero there)."""
    spread = F.sqrt(F.var_pop(F.when(F.col(y).isNotNull(), F.col(x)))) * F.sqrt(F.var_pop(F.when(F.col(x).isNotNull(), F.col(y))))
    return F.try_divide(F.covar_pop(x, y), spread)


def correlation_sql(x: str, y: str) -> str:
    return f"CASE WHEN isfinite(corr({x}, {y})) THEN corr({x}, {y}) END"
