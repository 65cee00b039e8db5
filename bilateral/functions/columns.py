"""Column builders that the operators share."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z95 = 1.959963984540054  # fixed value: 97.5 % point of the normal distribution
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch(ts: str) -> Column:
    """Whole seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, {ts})")


def div(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def gradient(value: Column, order: WindowSpec) -> Column:
    """Central differences, one-sided at both ends."""
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    return F.when(before.isNull(), after - value).when(after.isNull(), value - before).otherwise((after - before) / 2)


def weighted_history(value: str, weights: list[float], order: WindowSpec) -> Column:
    """Sum of weights[k] * the value k rows before; missing rows count 0."""
    rows = F.collect_list(value).over(order.rowsBetween(1 - len(weights), 0))
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(F.reverse(rows), F.slice(w, 1, F.size(rows)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


PARTS = 1024  # a group's order is cut into at most so many parts


def _with_base(df: DataFrame, keys: list[str], part: str, sums: dict[str, Column]) -> DataFrame:
    """df with what the parts before each row's own (of equal keys) sum up to, one column ``_b_<name>`` for each of ``sums``."""
    each = df.groupBy(*keys, part).agg(*[F.sum(c).alias(f"_b_{n}") for n, c in sums.items()])
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    base = each.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, part])], *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    same = F.lit(True)
    for i, k in enumerate([*keys, part]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(base, same).drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def shuffled_rank(df: DataFrame, keys: list[str], digest: Column, row: str, name: str) -> DataFrame:
    """Adds the place (from 1) of each row within keys, in the order of a hexadecimal digest, then of ``row``.

    The order is cut by the digest's first digits: parts are ranked apart and their counts added up, so a group of half of all rows
    isn't one task's work."""
    d = df.withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, 3))
    d = _with_base(d, keys, "_part", {"n": F.lit(1)})
    inside = F.row_number().over(W.partitionBy(*keys, "_part").orderBy("_digest", row))
    return d.withColumn(name, (F.col("_b_n") + inside).cast("long")).drop("_digest", "_part", "_b_n")


def running_sums(df: DataFrame, keys: list[str], value: str, sums: dict[str, str]) -> DataFrame:
    """Adds the sums (new name: column) over all rows of equal keys with at most the row's ``value`` (a number, distinct within keys).

    A group's values are cut into parts of equal width, which are summed apart and added up."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_lo", "_hi")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    part = F.coalesce(F.floor((F.col(value) - F.col("_lo")) / F.nullif((F.col("_hi") - F.col("_lo")).cast("double"), F.lit(0.0)) * PARTS), F.lit(0))
    d = df.join(ends, same).withColumn("_part", part.cast("int")).drop("_lo", "_hi", *[f"_k{i}" for i in range(len(keys))])
    d = _with_base(d, keys, "_part", {n: F.col(c) for n, c in sums.items()})
    upto = W.partitionBy(*keys, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumns({n: F.col(f"_b_{n}") + F.sum(c).over(upto) for n, c in sums.items()}).drop("_part", *[f"_b_{n}" for n in sums])


def average_rank(df: DataFrame, value: str, keys: list[str], name: str = "rank") -> DataFrame:
    """Adds the rank of ``value`` within keys, equal values sharing their mean rank.

    Ranks come from counts of distinct values, so a large group of few values costs few rows."""
    counts = running_sums(df.groupBy(*keys, value).agg(F.count("*").alias("_n")), keys, value, {"_upto": "_n"})
    ranks = counts.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value])


def holm(df: DataFrame, p: str, keys: list[str], tie: str, name: str = "p_holm") -> DataFrame:
    """Adds Holm's step-down correction of p within keys."""
    part = W.partitionBy(*keys)
    order = part.orderBy(p, tie)
    raw = df.withColumn("_raw", F.least(F.lit(1.0), (F.count("*").over(part) - F.row_number().over(order) + 1) * F.col(p)))
    return raw.withColumn(name, F.max("_raw").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_raw")


# fixed values: rational approximations of the complementary error function (small, middle and large arguments) ...
ERF_SMALL = ([1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3], [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3])
ERFC_MIDDLE = (
    [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3],
    [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3],
)
ERFC_LARGE = ([1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4], [1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3])
# ... and of the normal quantile (centre, tails, far tails), highest powers first
QUANTILE_CENTRE = (
    [2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080],
    [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0],
)
QUANTILE_TAIL = (
    [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0],
)
QUANTILE_FAR = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720],
    [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0],
)


def _ratio(x: Column, parts: tuple[list[float], list[float]]) -> Column:
    """A quotient of two polynomials, highest powers first."""
    top, bottom = (_horner(x, c) for c in parts)
    return top / bottom


def _horner(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def normal_tail(z: Column | str) -> Column:
    """P(N > z), as an expression (relative error below 1e-13 for z up to 37)."""

    def tail(z: Column) -> Column:
        x = F.abs(z) / math.sqrt(2)
        inverse = 1 / F.nullif(x * x, F.lit(0.0))
        small = 1 - x * _ratio(x * x, ERF_SMALL)
        large = F.exp(-x * x) / x * (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, ERFC_LARGE))
        upper = F.when(x <= 0.46875, small).when(x <= 4.0, F.exp(-x * x) * _ratio(x, ERFC_MIDDLE)).otherwise(large) / 2
        return F.when(z >= 0, upper).when(z.isNotNull(), 1 - upper)

    return let((F.col(z) if isinstance(z, str) else z).cast("double"), tail)


def normal_quantile(p: Column | str) -> Column:
    """The value that a normal variable stays below with chance p (0 < p < 1), as an expression."""

    def quantile(p: Column) -> Column:
        q = p - 0.5
        r = F.sqrt(-F.log(F.least(p, 1 - p)))
        tail = F.when(r <= 5, _ratio(r - 1.6, QUANTILE_TAIL)).otherwise(_ratio(r - 5, QUANTILE_FAR))
        return F.when((p <= 0) | (p >= 1), None).when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, QUANTILE_CENTRE)).otherwise(F.signum(q) * tail)

    return let((F.col(p) if isinstance(p, str) else p).cast("double"), quantile)


def _t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t by the incomplete beta function (continued fraction)."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) if x > 0 else 0.0

    def fraction(a, b, x):
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / (c if abs(c) > tiny else tiny)
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| > |t|) with df degrees of freedom."""
    return pd.Series([_t_two_sided(abs(a), b) if pd.notna(a) and pd.notna(b) and b > 0 else None for a, b in zip(t, df, strict=True)], dtype="float64")
