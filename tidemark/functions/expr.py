"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c) -> Column:
    """Null for null and for text that is empty after trimming."""
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def first_present(*columns: str) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def canonical_uuid(c: Column) -> Column:
    """Lower-case hyphenated form of a uuid given with braces, a urn prefix or without hyphens; null if it isn't one."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^urn:uuid:|[{}-]", "")
    parts = [F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def iso_date(c: Column) -> Column:
    """Date of text that starts as YYYY-MM-DD or is YYYYMMDD; null for anything else, such as a bare year."""
    text = F.trim(c)
    dashed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.substring(text, 1, 10))
    plain = F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))
    return F.coalesce(dashed, plain).try_cast("date")


def stable_id(prefix: str, *columns) -> Column:
    """Text id that depends on the columns' values alone."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *columns), 256), 1, 16))


def ratio(a: Column, b: Column) -> Column:
    return F.when((b != 0) & b.isNotNull(), a / b)


def median_of(values: Column) -> Column:
    """Median of an array without nulls; null for an empty one."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.get(ordered, ((n - 1) / 2).cast("int")), F.get(ordered, (n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def mad_of(values: Column) -> Column:
    """Median absolute deviation from the median, unscaled."""
    middle = median_of(values)
    return median_of(F.transform(values, lambda x: F.abs(x - middle)))


def population_sd(c: Column) -> Column:
    """Population standard deviation, null for fewer than two values."""
    return F.when(F.count(c) >= 2, F.stddev_pop(c))


def correlation(a: str, b: str, least: int = 2) -> Column:
    """Pearson correlation over rows where both are present; null for fewer than least, or where either doesn't vary.

    F.corr divides in every group, also where a condition around it does not hold, and so fails on one that doesn't vary.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count(x) >= least) & (sx > 1e-12) & (sy > 1e-12), F.covar_pop(x, y) / (sx * sy))


def season(date: Column) -> Column:
    m = F.month(date)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of the names whose conditions hold, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def size_bin(n: Column) -> Column:
    return F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 25, "6-25").when(n <= 100, "26-100").otherwise("101+")


def valid_fraction(c: Column, slack: float = 1e-9) -> Column:
    return c.isNull() | c.between(-slack, 1 + slack)


def rounded(df, digits: int = 6):
    """Every double rounded, for results whose last digits depend on the order of sums. As in SQL engines the scaled double is rounded; F.round alone rounds its decimal text, which differs on halves."""
    scale = float(10**digits)

    def one(name: str) -> Column:
        scaled = F.col(name) * scale
        return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / scale).otherwise(F.col(name))

    return df.select(*[one(n).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])
