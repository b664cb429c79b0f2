"""Statistical column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_RATE = 0.005


def log_factorial(n: Column) -> Column:
    """ln(n!) by summation: Spark has no lgamma."""
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2)).cast("int")), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double"))))


def log_poisson(n: Column, mu: Column) -> Column:
    return n * F.ln(mu) - mu - log_factorial(n)


def poisson(n: Column, mu: Column) -> Column:
    return F.exp(log_poisson(n, mu))


def log10_poisson_ratio(n: Column, mu1: Column, mu2: Column) -> Column:
    """log10 of the ratio of two Poisson probabilities; the factorials cancel."""
    return (n * (F.ln(mu1) - F.ln(mu2)) - mu1 + mu2) / math.log(10)


def expected_coverage(coverage: Column, mean_length: Column, length: Column, from_seeds: bool = False) -> Column:
    """Coverage of paths of a given length; negative becomes 0; trained from seeds, errors thin it."""
    cover = coverage / mean_length * (mean_length - length + 1)
    if from_seeds:
        cover = cover * F.pow(F.lit(1 - ERROR_RATE), length)
    return F.greatest(cover, F.lit(0.0))


def expected_multiplicity(mean_coverage: Column, mu: Column) -> Column:
    return F.round(mean_coverage / mu)


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole)


def sensitivity(tp: Column, fn: Column) -> Column:
    return F.when(tp + fn == 0, F.lit(1.0)).otherwise(tp / (tp + fn))


def specificity(tn: Column, fp: Column) -> Column:
    return F.when(tn + fp == 0, F.lit(1.0)).otherwise(tn / (tn + fp))


# mean and variance parametrise the negative binomial, as with counts more spread than Poisson's

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def log_negative_binomial(k, mu, var):
    """Natural log of the negative binomial pdf with mean mu and variance var > mu."""
    k, mu, var = np.asarray(k, float), np.asarray(mu, float), np.maximum(np.asarray(var, float), np.asarray(mu, float) * (1 + 1e-9))
    p, r = mu / var, mu * mu / (var - mu)
    return _lgamma(r + k) - _lgamma(k + 1) - _lgamma(r) + r * np.log(p) + k * np.log1p(-p)


def log_geometric(k, mu):
    """Natural log of the geometric pdf on 1, 2, ... with mean mu."""
    p = 1 / np.maximum(np.asarray(mu, float), 1 + 1e-12)
    return np.log(p) + (np.asarray(k, float) - 1) * np.log1p(-p)


def _udf(f):
    """A UDF made when asked for: workers import this module without a session."""

    def apply(*columns):
        return F.pandas_udf(f, "double")(*columns)

    return apply


def _negative_binomial(k: pd.Series, mu: pd.Series, var: pd.Series) -> pd.Series:
    return pd.Series(np.exp(log_negative_binomial(k, mu, var)))


def _geometric(k: pd.Series, mu: pd.Series) -> pd.Series:
    return pd.Series(np.exp(log_geometric(k, mu)))


def _negative_binomial_ratio(k: pd.Series, mu1: pd.Series, var1: pd.Series, mu2: pd.Series, var2: pd.Series) -> pd.Series:
    return pd.Series(np.exp(log_negative_binomial(k, mu1, var1) - log_negative_binomial(k, mu2, var2)))


def _geometric_ratio(k: pd.Series, mu1: pd.Series, mu2: pd.Series, var2: pd.Series) -> pd.Series:
    return pd.Series(np.exp(log_geometric(k, mu1) - log_negative_binomial(k, mu2, var2)))


negative_binomial = _udf(_negative_binomial)
geometric = _udf(_geometric)
negative_binomial_ratio = _udf(_negative_binomial_ratio)
geometric_ratio = _udf(_geometric_ratio)


def fit_mixture(values: np.ndarray, weights: np.ndarray, means: list[float], iterations: int = 50) -> list[dict]:
    """EM for a mixture of negative binomials on a histogram of counts.

    The histogram has one row per multiplicity (65,535 at most), so it is fitted on the driver.
    """
    values, weights = np.asarray(values, float), np.asarray(weights, float)
    mu = np.asarray(means, float)
    var = mu * 1.5 + 1e-3
    share = np.full(len(mu), 1 / len(mu))
    for _ in range(iterations):
        log_p = np.stack([log_negative_binomial(values, m, v) + np.log(max(s, 1e-300)) for m, v, s in zip(mu, var, share)])
        top = log_p.max(axis=0)
        resp = np.exp(log_p - top)
        resp /= resp.sum(axis=0)
        mass = (resp * weights).sum(axis=1) + 1e-12
        mu = np.maximum((resp * weights * values).sum(axis=1) / mass, 1e-6)
        var = np.maximum((resp * weights * (values - mu[:, None]) ** 2).sum(axis=1) / mass, mu * 1.0001)
        share = mass / mass.sum()
    return [{"component": i, "mu": float(m), "var": float(v), "share": float(s)} for i, (m, v, s) in enumerate(zip(mu, var, share))]


def coverage_cutoff(fit: list[dict], errors: int, limit: int = 1000) -> int:
    """The least multiplicity from which the error components are less likely than the true ones (odds below one half)."""
    k = np.arange(1, limit + 1)
    p = [np.exp(log_negative_binomial(k, c["mu"], c["var"])) * c["share"] for c in fit]
    odds = sum(p[:errors]) / np.maximum(sum(p[errors:]), 1e-300)
    below = np.flatnonzero(odds < 0.5)
    return int(k[below[0]]) if len(below) else limit


def genome_size(fit: list[dict], total: int, errors: int) -> int:
    """Distinct k-mers that the true components explain, by multiplicity."""
    true = fit[errors:]
    base = min(c["mu"] for c in true)
    return round(sum(c["share"] * total * max(1, round(c["mu"] / base)) for c in true))
