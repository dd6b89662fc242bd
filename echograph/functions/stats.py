"""Statistics as DataFrame aggregates, with p-values from closed forms or exact sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions import ordering


def upper_median(col: Column) -> Column:
    """The element at n // 2 of the sorted values: the upper middle of an even number. The values of a
    group are gathered; for groups too large for that use ``upper_median_by_rank``."""
    values = F.sort_array(F.collect_list(col))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def upper_median_by_rank(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """The same by place in a distributed order, without an array or a task of the group."""
    return ordering.middle(df, by, col)


def spearman(df: DataFrame, x: str, y: str, ties: str = "average", tie_break: list[str] | None = None) -> DataFrame:
    """(rho, n, p): correlation of ranks; p two-sided, by the t approximation, null under three rows."""
    r = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = ordering.ranked(ordering.ranked(r, x, "_rx", ties, tie_break=tie_break), y, "_ry", ties, tie_break=tie_break)
    out = r.agg(F.corr(F.col("_rx").cast("double"), F.col("_ry").cast("double")).alias("rho"), F.count("*").alias("n"))
    rows = [(q.rho, q.n, t_test_p(q.rho, q.n)) for q in out.collect()]  # one row
    return df.sparkSession.createDataFrame(rows, "rho double, n long, p double")


def t_test_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation over n pairs, by Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else beta_share((n - 2) / 2, 0.5, 1 - r * r)


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def mann_whitney(df: DataFrame, group: str, value: str, first, second) -> dict:
    """U of ``first`` against ``second``, two-sided p by the normal approximation with tie correction."""
    d = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()).select(group, value)
    d = ordering.ranked(d, value, "_r")
    per_value = d.groupBy(value).agg(F.count("*").alias("t"))
    tie = per_value.agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t"))).first()[0] or 0.0
    rows = {r[group]: r for r in d.groupBy(group).agg(F.count("*").alias("n"), F.sum("_r").alias("s")).collect()}  # two rows
    n1, n2 = (rows[k].n if k in rows else 0 for k in (first, second))
    if not n1 or not n2:
        return {"u": None, "p": None, "n1": n1, "n2": n2}
    u = rows[first].s - n1 * (n1 + 1) / 2
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))) if n > 1 else 0.0
    p = normal_p(max(0.0, abs(u - n1 * n2 / 2) - 0.5) / sd) if sd else 1.0
    return {"u": u, "p": p, "n1": n1, "n2": n2}


def holm(df: DataFrame, p: str = "p", key: str = "test") -> DataFrame:
    """Step-down adjusted p-values: the running maximum of p times the tests left, 1 at most."""
    order = Window.partitionBy(F.lit(1)).orderBy(p, key)
    all_rows = Window.partitionBy(F.lit(1))
    scaled = df.withColumn("_s", F.least(F.lit(1.0), F.col(p) * (F.count("*").over(all_rows) - F.row_number().over(order) + 1)))
    return scaled.withColumn("p_holm", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi2_gof(df: DataFrame, observed: str, expected: str) -> dict:
    """Chi-square of observed against expected counts. What was not expected at all is infinitely far off if
    observed; a row without an expected count adds nothing, and no such counts give neither chi2 nor p."""
    term = F.when(F.col(expected) != 0, F.try_divide((F.col(observed) - F.col(expected)) ** 2, F.col(expected))).when((F.col(expected) == 0) & (F.col(observed) != 0), F.lit(math.inf))
    row = df.agg(F.sum(term).alias("x"), F.count("*").alias("k")).first()
    p = None if row.x is None else 0.0 if math.isinf(row.x) else upper_gamma((row.k - 1) / 2, row.x / 2)
    return {"chi2": row.x, "df": row.k - 1, "p": p}


def binom_test(k: int, n: int, p: float = 0.5) -> float:
    """Two-sided exact: the outcomes no likelier than k."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)
    cut = log(k) + 1e-7
    return min(1.0, sum(math.exp(v) for i in range(n + 1) if (v := log(i)) <= cut))


def mcnemar(b: int, c: int) -> dict:
    """Continuity-corrected chi-square of the two discordant counts."""
    chi2 = max(0, abs(b - c) - 1) ** 2 / (b + c) if b + c else 0.0
    return {"chi2": chi2, "p": upper_gamma(0.5, chi2 / 2)}


def z_against_null(observed: float, null: DataFrame, statistic: str) -> dict:
    row = null.agg(F.avg(statistic).alias("m"), F.stddev_pop(statistic).alias("s"), F.count("*").alias("n")).first()
    return {"observed": observed, "mean": row.m, "sd": row.s, "z": (observed - row.m) / row.s if row.s else None, "reps": row.n}
