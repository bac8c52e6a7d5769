"""Seven probability distributions as Column builders, by Spark expressions or Arrow UDFs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship

INF, NAN = float("inf"), float("nan")


def _each(fn, *columns: Column) -> Column:
    """A scalar function over a batch of doubles; null stays null."""
    ship()

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([fn(v) if v == v else NAN for v in x.tolist()], dtype="float64")

    return F.when(columns[0].isNotNull(), run(*columns))


def ln_gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d or 1e-300)
            c = 1 + t / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def bisect(cdf, p: float, low: float, high: float) -> float:
    """The x with cdf(x) = p; the bracket is widened until it holds it."""
    while cdf(low) > p and low > -1e300:
        low = low * 2 if low < 0 else -1.0
    while cdf(high) < p and high < 1e300:
        high = high * 2 if high > 0 else 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


class Distribution:
    """pdf, cdf and ppf of a column; sample of rows; mean and variance."""

    support = (-INF, INF)

    def pdf(self, x: Column) -> Column:
        return _each(self.pdf_at, x)

    def cdf(self, x: Column) -> Column:
        return _each(self.cdf_at, x)

    def ppf(self, p: Column) -> Column:
        return _each(self.ppf_at, p)

    def ppf_at(self, p: float) -> float:
        if not 0 < p < 1:
            return self.support[0] if p <= 0 else self.support[1]
        return bisect(self.cdf_at, p, self.mean_or(0) - 1, self.mean_or(0) + 1)

    def mean_or(self, other: float) -> float:
        return self.mean if math.isfinite(self.mean) else other

    def sample(self, seed: int) -> Column:
        """A draw a row, by the inverse of the distribution function."""
        return self.ppf(F.greatest(F.rand(seed), F.lit(1e-300)))


@dataclass(frozen=True)
class Normal(Distribution):
    mu: float = 0.0
    sigma: float = 1.0

    def __post_init__(self):
        object.__setattr__(self, "sigma", self.sigma if self.sigma > 0 else 1.0)

    @property
    def mean(self) -> float:
        return self.mu

    @property
    def variance(self) -> float:
        return self.sigma**2

    def pdf(self, x: Column) -> Column:
        z = (x - self.mu) / self.sigma
        return F.exp(-z * z / 2) / (self.sigma * math.sqrt(2 * math.pi))

    def cdf_at(self, x: float) -> float:
        return 0.5 * math.erfc(-(x - self.mu) / (self.sigma * math.sqrt(2)))

    def ppf_at(self, p: float) -> float:
        from statistics import NormalDist

        return NormalDist(self.mu, self.sigma).inv_cdf(p) if 0 < p < 1 else -INF if p <= 0 else INF

    def sample(self, seed: int) -> Column:
        return F.randn(seed) * self.sigma + self.mu


@dataclass(frozen=True)
class Uniform(Distribution):
    low: float = 0.0
    high: float = 1.0

    def __post_init__(self):
        object.__setattr__(self, "high", self.high if self.high > self.low else self.low + 1)

    @property
    def mean(self) -> float:
        return (self.low + self.high) / 2

    @property
    def variance(self) -> float:
        return (self.high - self.low) ** 2 / 12

    def pdf(self, x: Column) -> Column:
        return F.when(x.between(self.low, self.high), 1 / (self.high - self.low)).when(x.isNotNull(), 0.0)

    def cdf(self, x: Column) -> Column:
        return F.when(x <= self.low, 0.0).when(x >= self.high, 1.0).otherwise((x - self.low) / (self.high - self.low))

    def ppf(self, p: Column) -> Column:
        return F.when(p <= 0, self.low).when(p >= 1, self.high).otherwise(p * (self.high - self.low) + self.low)

    def sample(self, seed: int) -> Column:
        return F.rand(seed) * (self.high - self.low) + self.low


@dataclass(frozen=True)
class Exponential(Distribution):
    rate: float = 1.0

    def __post_init__(self):
        object.__setattr__(self, "rate", self.rate if self.rate > 0 else 1.0)

    @property
    def mean(self) -> float:
        return 1 / self.rate

    @property
    def variance(self) -> float:
        return 1 / self.rate**2

    def pdf(self, x: Column) -> Column:
        return F.when(x < 0, 0.0).otherwise(F.exp(-x * self.rate) * self.rate)

    def cdf(self, x: Column) -> Column:
        return F.when(x < 0, 0.0).otherwise(-F.expm1(-x * self.rate))

    def ppf(self, p: Column) -> Column:
        return F.when(p <= 0, 0.0).when(p >= 1, INF).otherwise(-F.log1p(-p) / self.rate)

    def sample(self, seed: int) -> Column:
        return -F.log1p(-F.rand(seed)) / self.rate


class _Counting(Distribution):
    """Distributions on whole numbers; ppf is the smallest k whose cdf reaches p."""

    def pdf_at(self, x: float) -> float:
        k = math.floor(x + 0.5)
        return math.exp(self.log_mass(k)) if self.inside(k) else 0.0

    def ppf_at(self, p: float) -> float:
        if not 0 < p < 1:
            return 0.0 if p <= 0 else self.support[1]
        low, high = -1, 1
        while self.cdf_at(high) < p:
            low, high = high, high * 2
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.cdf_at(mid) < p else (low, mid)
        return float(high)


@dataclass(frozen=True)
class Poisson(_Counting):
    lam: float = 1.0
    support: tuple = field(default=(0.0, INF), repr=False)

    def __post_init__(self):
        object.__setattr__(self, "lam", self.lam if self.lam > 0 else 1.0)

    @property
    def mean(self) -> float:
        return self.lam

    variance = mean

    def inside(self, k: int) -> bool:
        return k >= 0

    def log_mass(self, k: int) -> float:
        return k * math.log(self.lam) - self.lam - math.lgamma(k + 1)

    def cdf_at(self, x: float) -> float:
        return 0.0 if x < 0 else 1 - ln_gamma_p(math.floor(x) + 1, self.lam)


@dataclass(frozen=True)
class Binomial(_Counting):
    n: int = 1
    p: float = 0.5
    support: tuple = field(default=(0.0, INF), repr=False)

    def __post_init__(self):
        object.__setattr__(self, "n", max(1, self.n))
        object.__setattr__(self, "p", min(1.0, max(0.0, self.p)))
        object.__setattr__(self, "support", (0.0, float(self.n)))

    @property
    def mean(self) -> float:
        return self.n * self.p

    @property
    def variance(self) -> float:
        return self.n * self.p * (1 - self.p)

    def inside(self, k: int) -> bool:
        return 0 <= k <= self.n and not (self.p == 0 and k > 0) and not (self.p == 1 and k < self.n)

    def log_mass(self, k: int) -> float:
        some = k * math.log(self.p) if k else 0.0
        rest = (self.n - k) * math.log1p(-self.p) if k < self.n else 0.0
        return math.lgamma(self.n + 1) - math.lgamma(k + 1) - math.lgamma(self.n - k + 1) + some + rest

    def cdf_at(self, x: float) -> float:
        k = math.floor(x)
        return 0.0 if k < 0 else 1.0 if k >= self.n else beta_i(self.n - k, k + 1, 1 - self.p)


@dataclass(frozen=True)
class StudentT(Distribution):
    df: float = 1.0

    def __post_init__(self):
        object.__setattr__(self, "df", self.df if self.df > 0 else 1.0)

    @property
    def mean(self) -> float:
        return 0.0 if self.df > 1 else NAN

    @property
    def variance(self) -> float:
        return self.df / (self.df - 2) if self.df > 2 else INF if self.df > 1 else NAN

    def pdf(self, x: Column) -> Column:
        front = math.exp(math.lgamma((self.df + 1) / 2) - math.lgamma(self.df / 2)) / math.sqrt(self.df * math.pi)
        return F.pow(1 + x * x / self.df, F.lit(-(self.df + 1) / 2)) * front

    def cdf_at(self, x: float) -> float:
        if math.isinf(x):
            return float(x > 0)
        tail = beta_i(self.df / 2, 0.5, self.df / (self.df + x * x)) / 2
        return tail if x < 0 else 1 - tail

    def sample(self, seed: int) -> Column:
        """A normal draw over the root of a chi-squared one, by its own inverse."""
        return F.randn(seed) / F.sqrt(ChiSquared(self.df).ppf(F.greatest(F.rand(seed + 1), F.lit(1e-300))) / self.df)


@dataclass(frozen=True)
class ChiSquared(Distribution):
    df: float = 1.0
    support: tuple = field(default=(0.0, INF), repr=False)

    def __post_init__(self):
        object.__setattr__(self, "df", self.df if self.df > 0 else 1.0)

    @property
    def mean(self) -> float:
        return self.df

    @property
    def variance(self) -> float:
        return 2 * self.df

    def pdf_at(self, x: float) -> float:
        k = self.df / 2
        if x <= 0:
            return 0.0 if x < 0 or k > 1 else 0.5 if k == 1 else INF
        return math.exp((k - 1) * math.log(x) - x / 2 - k * math.log(2) - math.lgamma(k))

    def cdf_at(self, x: float) -> float:
        return ln_gamma_p(self.df / 2, x / 2)

