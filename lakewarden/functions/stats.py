"""Statistics as column expressions: intervals, tests and effect sizes over counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def rate(part: Column | str, whole: Column | str, digits: int | None = None) -> Column:
    """part / whole, 0 where whole is 0."""
    value = F.when(_c(whole) == 0, F.lit(0.0)).otherwise(_c(part).cast("double") / F.nullif(_c(whole).cast("double"), F.lit(0.0)))
    return value if digits is None else F.round(value, digits)


def rounded(value: Column | str, digits: int) -> Column:
    """``value`` rounded half away from zero; a nudge keeps halves that binary fractions miss by a hair from going the other way."""
    return F.round(_c(value) + F.signum(_c(value)) * 1e-9, digits)


def wilson(successes: Column | str, total: Column | str, digits: int = 4) -> tuple[Column, Column]:
    """The ends of the 95 % Wilson interval; both 0 where total is 0."""
    k, n = _c(successes).cast("double"), F.nullif(_c(total).cast("double"), F.lit(0.0))
    p, z2 = k / n, Z95**2
    centre, margin = p + z2 / (2 * n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), (centre - margin) / (1 + z2 / n)), F.least(F.lit(1.0), (centre + margin) / (1 + z2 / n))
    return tuple(F.coalesce(F.round(F.when(n.isNotNull(), x), digits), F.lit(0.0)) for x in (low, high))


def erf(x: Column | str) -> Column:
    """The error function for x >= 0, by its series with terms 2 x^2 / (2 k + 1); 1 beyond 6."""
    x = _c(x).cast("double")
    start = F.struct(x.alias("term"), x.alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * 2 * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda k: k.cast("double")), start, step)["sum"]
    return F.when(x > 6, F.lit(1.0)).otherwise(total * F.exp(-x * x) * (2 / math.sqrt(math.pi)))


def two_proportions(k_a: Column | str, n_a: Column | str, k_b: Column | str, n_b: Column | str) -> tuple[Column, Column]:
    """z and two-sided p of the pooled two-proportion test; (0, 1) where it isn't defined."""
    k_a, n_a, k_b, n_b = (_c(x).cast("double") for x in (k_a, n_a, k_b, n_b))
    pooled = (k_a + k_b) / F.nullif(n_a + n_b, F.lit(0.0))
    spread = F.nullif(F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(n_a, F.lit(0.0)) + 1 / F.nullif(n_b, F.lit(0.0)))), F.lit(0.0))
    z = F.coalesce((k_a / F.nullif(n_a, F.lit(0.0)) - k_b / F.nullif(n_b, F.lit(0.0))) / spread, F.lit(0.0))
    return z, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - erf(F.abs(z) / math.sqrt(2))))


def mcnemar(b: Column | str, c: Column | str) -> tuple[Column, Column]:
    """Continuity-corrected chi-square and p of discordant counts; (0, 1) without any."""
    b, c = _c(b).cast("double"), _c(c).cast("double")
    chi = F.when(b + c == 0, F.lit(0.0)).otherwise((F.abs(b - c) - 1) * (F.abs(b - c) - 1) / F.nullif(b + c, F.lit(0.0)))
    p = F.when(b + c == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - erf(F.sqrt(chi / 2)))))
    return chi, p


def cohens_h(rate_a: Column | str, rate_b: Column | str) -> Column:
    return 2 * (F.asin(F.sqrt(_c(rate_a))) - F.asin(F.sqrt(_c(rate_b))))


def holm(df: DataFrame, p: str, out: str, tie: list[str], within: list[str] | None = None) -> DataFrame:
    """Adds the Holm step-down correction of ``p``, rounded to 6; ties are ranked by ``tie``.

    One row per comparison: a family of tests is small (pairs of models), so one window task
    per family is enough.
    """
    family = Window.partitionBy(*(within or [F.lit(0)]))
    ranked = df.withColumn("_rank", F.row_number().over(family.orderBy(p, *tie))).withColumn("_n", F.count(F.lit(1)).over(family))
    corrected = F.least(F.lit(1.0), (F.col("_n") - F.col("_rank") + 1) * F.col(p))
    running = family.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(out, F.round(F.max(corrected).over(running), 6)).drop("_rank", "_n")
