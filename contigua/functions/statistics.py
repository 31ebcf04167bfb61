"""Distributions in log space, as column expressions over whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_factorial(k: Column) -> Column:
    return F.when(k < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(k.cast("int"), F.lit(2))), F.lit(0.0), lambda s, x: s + F.log(x.cast("double"))))


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def log_poisson(k: Column, mean: Column) -> Column:
    return k * F.log(mean) - mean - log_factorial(k)


def log_binomial(k: Column, n: Column, p: Column) -> Column:
    return log_choose(n, k) + k * F.log(p) + (n - k) * F.log(1 - p)


def log_beta_function(a: Column, b: Column) -> Column:
    return log_factorial(a - 1) + log_factorial(b - 1) - log_factorial(a + b - 1)


def log_beta(x: Column, a: Column, b: Column) -> Column:
    """Density of the beta distribution with whole parameters."""
    return (a - 1) * F.log(x) + (b - 1) * F.log(1 - x) - log_beta_function(a, b)


def log_beta_binomial(k: Column, n: Column, a: Column, b: Column) -> Column:
    return log_choose(n, k) + log_beta_function(k + a, n - k + b) - log_beta_function(a, b)
