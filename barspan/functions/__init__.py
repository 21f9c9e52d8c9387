"""Column functions.  Undefined results are null, never NaN; masks are false where undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def mask(condition: Column) -> Column:
    """A condition that is false, not null, where it cannot be told."""
    return F.coalesce(condition, F.lit(False))


def true_range(previous_close: Column) -> Column:
    """greatest() skips nulls, so the first bar's range is high - low."""
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous_close), F.abs(F.col("low") - previous_close))


def adjusted_skew(x: Column) -> Column:
    n = F.count(x)
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: Column) -> Column:
    """Excess kurtosis, corrected for sample size."""
    n = F.count(x)
    return F.when(n >= 4, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def t_stat(x: Column) -> Column:
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= 2) & (sd > 0), F.avg(x) / (sd / F.sqrt(F.count(x))))


def share(condition: Column) -> Column:
    return F.avg(mask(condition).cast("double"))


def profit_factor(x: Column, variant: str = "a") -> Column:
    """Wins over losses.  Without losses: a +Inf if there are wins, else null; b null; c +Inf; d as c, where zeros count as losses."""
    wins = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0))
    losses = -F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0))
    no_loss = (F.count_if(x <= 0) == 0) if variant == "d" else (losses == 0)
    inf, null = F.lit(float("inf")), F.lit(None).cast("double")
    empty = {"a": F.when(wins > 0, inf), "b": null, "c": inf, "d": inf}[variant]
    return F.when(no_loss | (losses == 0), empty).otherwise(wins / losses)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a rate; null for n = 0."""
    p, n = ratio(hits, n), F.when(n != 0, n)
    centre, half, scale = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n), 1 + z * z / n
    return (centre - half) / scale, (centre + half) / scale


def right_closed(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the bin (edge, next edge] that holds x; the lowest edge belongs to the first bin."""
    out = F.when((x >= edges[0]) & (x <= edges[1]), labels[0])
    for k in range(1, len(labels)):
        out = out.when((x > edges[k]) & (x <= edges[k + 1]), labels[k])
    return out


#: Lanczos coefficients of the gamma function (g = 7, nine terms).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0."""
    z = x - 1
    base = z + 7.5
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + k)
    return 0.5 * F.log(F.lit(2.0) * F.pi()) + (z + 0.5) * F.log(base) - base + F.log(total)


def beta_share(a: Column, b: Column, x: Column, terms: int = 300) -> Column:
    """Regularised incomplete beta function for 0 <= x <= 1 by its continued fraction."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def fraction(a: Column, b: Column, x: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("c"), (1 / safe(1 - (a + b) * x / (a + 1))).alias("d"))
        first = F.struct(start["c"].alias("c"), start["d"].alias("d"), start["d"].alias("h"))

        def step(s: Column, k: Column) -> Column:
            m = k.cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            half = F.struct((1 / safe(1 + even * s["d"])).alias("d"), safe(1 + even / s["c"]).alias("c"), s["h"].alias("h"))
            return F.transform(F.array(half), lambda t: F.struct(safe(1 + odd / t["c"]).alias("c"), (1 / safe(1 + odd * t["d"])).alias("d"), (t["h"] * t["d"] * t["c"] * safe(1 + odd / t["c"]) / safe(1 + odd * t["d"])).alias("h")))[0]

        return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), first, step)["h"]

    front = lambda a, b, x: F.exp(a * F.log(x) + b * F.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))
    near = front(a, b, x) * fraction(a, b, x) / a
    far = 1 - front(b, a, 1 - x) * fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), near).otherwise(far)


def t_p_value(t: Column, freedom: Column) -> Column:
    """Two-sided p of Student's t; null where freedom is under 1."""
    v = F.when(freedom >= 1, freedom.cast("double"))
    return beta_share(v / 2, F.lit(0.5), v / (v + t * t))


def normal_tail(z: Column) -> Column:
    """Share of the standard normal distribution above z."""
    size = F.abs(z)
    density = F.exp(-z * z / 2) / F.sqrt(2 * F.pi())
    start = F.struct(size.alias("term"), size.alias("sum"))
    grow = lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * z * z / (2 * k + 1)).alias("sum"))
    series = 0.5 - density * F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, grow)["sum"]
    fraction = density / F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), size, lambda s, k: size + k / s)
    above = F.when(size <= 4, series).otherwise(fraction)
    return F.when(z >= 0, above).otherwise(1 - above)


def normal_quantile(p: Column, rounds: int = 8) -> Column:
    """z that a share p of the standard normal distribution lies below; null outside (0, 1)."""
    low = F.least(p, 1 - p)
    r = F.sqrt(-2 * F.log(low))
    # A rough start (error under 0.003), then Newton-like steps on the distribution.
    start = -(r - (2.30753 + 0.27061 * r) / (1 + 0.99229 * r + 0.04481 * r * r))

    def step(z: Column, _: Column) -> Column:
        def better(s: Column) -> Column:
            u = (s["tail"] - low) * F.sqrt(2 * F.pi()) * F.exp(s["z"] * s["z"] / 2)
            return s["z"] - u / (1 + s["z"] * u / 2)

        return F.transform(F.array(F.struct(z.alias("z"), normal_tail(-z).alias("tail"))), better)[0]

    z = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return F.when((p > 0) & (p < 1), F.when(p == 0.5, 0.0).when(p < 0.5, z).otherwise(-z))


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation by Fisher's z; null for n <= 3."""
    inside = F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999))
    return F.when(n > 3, 2 * normal_tail(F.abs(0.5 * F.log((1 + inside) / (1 - inside)) * F.sqrt(n - 3))))
