"""Discrete power-law fits of histograms (maximum likelihood, least Kolmogorov-Smirnov x_min)."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph import scratch

SCHEMA = "chunk_id int, alpha double, x_min double, L double, D double, p_value double, elapsed_time long"


def zeta(alpha: float, a: np.ndarray) -> np.ndarray:
    """Hurwitz zeta by Euler-Maclaurin summation from a shifted start."""
    a = np.asarray(a, float)
    head = sum((a + k) ** -alpha for k in range(12))
    b = a + 12
    s = alpha
    tail = b ** (1 - s) / (s - 1) + 0.5 * b**-s + s * b ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * b ** (-s - 3) / 720
    return head + tail


def _alpha(x: np.ndarray, n: np.ndarray, low: float) -> tuple[float, float]:
    total, logs = n.sum(), (n * np.log(x)).sum()
    nll = lambda s: total * np.log(zeta(s, low)) + s * logs
    a, b = 1.01, 12.0
    ratio = (np.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    for _ in range(60):
        if nll(c) < nll(d):
            b, d = d, c
            c = b - ratio * (b - a)
        else:
            a, c = c, d
            d = a + ratio * (b - a)
    s = (a + b) / 2
    return s, -float(nll(s))


def fit_histogram(x: np.ndarray, n: np.ndarray) -> tuple[float, float, float, float, float]:
    """``(alpha, x_min, log-likelihood, D, p)``; p by the asymptotic Kolmogorov law."""
    keep = (x >= 1) & (n > 0)
    order = np.argsort(x[keep])
    x, n = x[keep][order].astype(float), n[keep][order].astype(float)
    best = None
    for i in range(max(1, len(x) - 1)):
        if i and n[i:].sum() < 10:
            break
        s, like = _alpha(x[i:], n[i:], x[i])
        model = 1 - zeta(s, x[i:] + 1) / zeta(s, x[i])
        gap = float(np.abs(np.cumsum(n[i:]) / n[i:].sum() - model).max())
        if best is None or gap < best[3]:
            best = (s, x[i], like, gap, n[i:].sum())
    s, low, like, gap, total = best
    t = (np.sqrt(total) + 0.12 + 0.11 / np.sqrt(total)) * gap
    p = float(np.clip(2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * t * t) for k in range(1, 101)), 0, 1)) if t > 0.2 else 1.0
    return s, low, like, gap, p


def fit(dist: DataFrame, value: str, freq: str, group: str = "chunk_id") -> DataFrame:
    """One fit per group.  A group is a histogram: one row per distinct degree, not per node."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        began = time.time()
        x, n = pdf["x"].to_numpy(float), pdf["n"].to_numpy(float)
        found = fit_histogram(x, n) if ((x >= 1) & (n > 0)).sum() > 1 else (np.nan,) * 5
        return pd.DataFrame([[int(pdf["g"].iloc[0]), *found, int(time.time() - began)]], columns=["chunk_id", "alpha", "x_min", "L", "D", "p_value", "elapsed_time"])

    scratch.ship_package(dist.sparkSession)
    rows = dist.groupBy(F.col(group).cast("int").alias("g"), F.col(value).cast("long").alias("x")).agg(F.sum(freq).cast("long").alias("n"))
    return rows.groupBy("g").applyInPandas(one, SCHEMA)


def closed_form(dist: DataFrame, value: str, freq: str, x_min: int = 1, group: str = "chunk_id") -> DataFrame:
    """``(group, n, alpha)``: alpha = 1 + n / sum ln(x / (x_min - 1/2)) over values from x_min on."""
    rows = dist.where(F.col(value) >= x_min)
    logs = F.sum(F.col(freq) * F.log(F.col(value) / F.lit(x_min - 0.5)))
    return rows.groupBy(group).agg(F.sum(freq).cast("long").alias("n"), (1 + F.sum(freq) / logs).alias("alpha"))
