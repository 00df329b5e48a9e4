"""Small column expressions shared by the operators (rounding rules, guarded lists, text formats)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def js_round(c: Column) -> Column:
    """Half up toward plus infinity, as a dashboard rounds."""
    return F.floor(c + F.lit(0.5))


def half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def truthy_or(c: Column, default) -> Column:
    """``c || default``: empty text, zero and null all give the default."""
    empty = F.lit("") if isinstance(default, str) else F.lit(0)
    return F.coalesce(F.nullif(c, empty), F.lit(default))


def keep(*items: Column) -> Column:
    """An array of the items that are not null, in order.

    Joined from arrays of one or none, not filtered with a lambda: a lambda would take its whole input, all the
    conditions, out of the generated code.
    """
    return F.concat(*[F.when(i.isNotNull(), F.array(i)).otherwise(F.array()) for i in items])


def fixed(c: Column, places: int, ties: str = "even") -> Column:
    """Text with a fixed number of decimals, rounded by the exact value of the double: 8.585 is a little more than it reads,
    so it becomes 8.59, and 1.005 becomes 1.00. Real ties (0.125) go to the even digit, or with ``ties`` up away from 0.

    The product with the power of ten is taken with its rounding error: the double is split in two halves whose products are
    exact. Values too large to have such decimals are written as they are."""
    scale = float(10**places)
    x = F.abs(c.cast("double"))
    high = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    rest = product - whole
    tie = (rest == 0.5) & (error == 0)
    up = (rest > 0.5) | ((rest == 0.5) & (error > 0)) | (tie & ((whole % 2 == 1) if ties == "even" else F.lit(True)))
    n = (whole + up.cast("long")).cast("long")
    power = F.lit(10**places)
    digits = n.cast("string") if places == 0 else F.concat(F.floor(n / power).cast("string"), F.lit("."), F.lpad((n % power).cast("string"), places, "0"))
    sign = F.when(c < 0, "-").otherwise("")
    return F.when(x < 2.0**50 / scale, F.concat(sign, digits)).otherwise(F.format_string(f"%.{places}f", c.cast("double")))


def whole_percent(c: Column) -> Column:
    return F.concat(fixed(c * 100, 0), F.lit("%"))


def micros(c: Column | str) -> Column:
    return F.unix_micros(c)


def age_days(ts: Column | str, as_of: Column) -> Column:
    """Whole days between ``ts`` and ``as_of``; a row is inside an N day window when 0 <= age < N."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(MICROS_PER_DAY)).cast("int")


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL {days} DAYS")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null when b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def prettify(c: Column) -> Column:
    """``churn_risk`` -> ``Churn Risk``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def stable_id(prefix: str, *parts: Column) -> Column:
    """A rerun of the same batch writes the same ids."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16))


def ttl_stamp(ts: Column, days: int) -> Column:
    return F.unix_timestamp(ts) + F.lit(days * 86400)


def utc_text(c: Column) -> Column:
    """ISO text with or without a trailing ``Z`` to an instant; null when it is not a time."""
    return F.try_to_timestamp(F.when(c.endswith("Z"), c).otherwise(F.concat(c, F.lit("Z"))))
