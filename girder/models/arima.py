"""Forecast of many monthly series by an ARIMA(1,1,1) per series, by exact likelihood.

The series is written in state space: the level, its change w[t] = phi w[t-1] +
e[t] + theta e[t-1], and theta e[t]. A Kalman filter starts at the first
observed month with the stationary spread of the change, and gives the exact
Gaussian likelihood of all later months, given the first. A month without a
value is predicted and not corrected, so gaps need no filling. The variance of
e has a closed form; phi and theta are searched, many pairs at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_MONTHS = 5  # phi, theta and the variance need four changes
BOUND = 0.98
GRID, ZOOMS = 29, 7


@dataclass
class Filtered:
    """The state after the last month for every (phi, theta), and what the months say about them.

    ``means`` are level, change and theta e; ``spread`` their covariances over
    the variance of e, in the order 11, 12, 13, 22, 23, 33.
    """

    means: list[np.ndarray]
    spread: list[np.ndarray]
    squares: np.ndarray
    logs: np.ndarray
    observed: int

    @property
    def variance(self) -> np.ndarray:
        return self.squares / self.observed

    @property
    def log_likelihood(self) -> np.ndarray:
        """At the best variance."""
        n = self.observed
        return -0.5 * (n * (np.log(2 * np.pi) + 1 + np.log(np.maximum(self.variance, 1e-300))) + self.logs)


def _step(means: list, spread: list, phi: np.ndarray, theta: np.ndarray) -> tuple[list, list]:
    """State and spread one month on, before that month is seen."""
    level, change, shock = means
    p11, p12, p13, p22, p23, p33 = spread
    moved = phi * change + shock
    own = phi * phi * p22 + 2 * phi * p23 + p33
    shared = phi * p12 + p13
    zero = np.zeros_like(phi)
    return [level + moved, moved, zero], [p11 + 2 * shared + own + 1, shared + own + 1, theta, own + 1, theta, theta * theta]


def kalman(y: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> Filtered:
    """The months ``y`` (NaN where none is known, the first is) filtered with every pair of ``phi`` and ``theta``."""
    zero = np.zeros_like(phi)
    means = [zero + y[0], zero, zero]
    spread = [zero, zero, zero, (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi), theta, theta * theta]
    squares, logs, observed = zero.copy(), zero.copy(), 0
    for value in y[1:]:
        means, spread = _step(means, spread, phi, theta)
        if np.isnan(value):
            continue
        p11, p12, p13, p22, p23, p33 = spread
        miss = value - means[0]
        squares += miss * miss / p11
        logs += np.log(p11)
        observed += 1
        means = [zero + value, means[1] + p12 / p11 * miss, means[2] + p13 / p11 * miss]
        spread = [zero, zero, zero, p22 - p12 * p12 / p11, p23 - p12 * p13 / p11, p33 - p13 * p13 / p11]
    return Filtered(means, spread, squares, logs, observed)


def fit_series(y: np.ndarray) -> tuple[float, float, float, Filtered]:
    """phi, theta, the variance of e, and the state after the last month."""
    low, high = np.full(2, -BOUND), np.full(2, BOUND)
    for _ in range(ZOOMS):
        axes = [np.linspace(a, b, GRID) for a, b in zip(low, high, strict=True)]
        phi, theta = (g.ravel() for g in np.meshgrid(*axes, indexing="ij"))
        found = kalman(y, phi, theta)
        best = int(found.log_likelihood.argmax())
        at, width = np.array([phi[best], theta[best]]), (high - low) / (GRID - 1)
        low, high = np.maximum(at - 2 * width, -BOUND), np.minimum(at + 2 * width, BOUND)
    one = kalman(y, at[:1], at[1:])
    return float(at[0]), float(at[1]), float(one.variance[0]), one


def forecast_series(y: np.ndarray, steps: int, level: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Point forecasts and half widths of the interval."""
    phi, theta, variance, state = fit_series(y)
    phi, theta = np.array([phi]), np.array([theta])
    means, spread = state.means, state.spread
    middle, spreads = np.empty(steps), np.empty(steps)
    for h in range(steps):
        means, spread = _step(means, spread, phi, theta)
        middle[h], spreads[h] = means[0][0], spread[0][0]
    return middle, NormalDist().inv_cdf(0.5 + level / 2) * np.sqrt(variance * spreads)


def on_months(numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values in the order of their month numbers, NaN for the months between that have none."""
    out = np.full(int(numbers[-1] - numbers[0]) + 1, np.nan)
    out[(numbers - numbers[0]).astype(int)] = values
    return out


def forecast(df: DataFrame, value: str, steps: int = 6, level: float = 0.9, month: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Forecast of each series for the months after its last known one.

    One row per series and step with ``forecast``, ``lower`` and ``upper``.
    Months without a row, or with NULL or NaN, are gaps and are not guessed. A
    series that changes by the same amount in every month goes on by it, with an
    interval of width 0. One with fewer known months than the model has
    unknowns gets NULLs and a ``reason``; without any known month the steps
    follow its last row. A series has one row per month, so a task holds a few
    hundred values per key.
    """
    by = list(by) or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if by == ["_all"] else df
    rows = rows.select(*by, month, F.col(value).cast("double").alias("_y"))
    out = T.StructType([rows.schema[b] for b in by])
    out.add("step", T.IntegerType()).add("_last", T.DateType())
    for c in ("forecast", "lower", "upper"):
        out.add(c, T.DoubleType())
    out.add("reason", T.StringType())

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(month)
        last = pdf[month].iloc[-1]
        known = pdf[np.isfinite(pdf["_y"].to_numpy(dtype=float))]
        middle = half = np.full(steps, np.nan)
        reason = None
        if len(known):
            last = known[month].iloc[-1]
            days = pd.to_datetime(known[month])
            y = on_months((days.dt.year * 12 + days.dt.month).to_numpy(), known["_y"].to_numpy(dtype=float))
            at = np.flatnonzero(~np.isnan(y))
            rates = np.diff(y[at]) / np.diff(at)
        if len(known) > 2 and np.ptp(rates) == 0:
            middle, half = y[-1] + rates[0] * np.arange(1, steps + 1), np.zeros(steps)
        elif len(known) < MIN_MONTHS:
            reason = "too short"
        else:
            middle, half = forecast_series(y, steps, level)
        result = pd.DataFrame({"step": np.arange(1, steps + 1), "_last": last})
        for name, part in zip(by, key):
            result[name] = part
        result["forecast"], result["lower"], result["upper"] = middle, middle - half, middle + half
        result["reason"] = reason
        return result[[f.name for f in out]]

    predicted = rows.groupBy(*by).applyInPandas(run, out)
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("forecast", "lower", "upper")}
    return predicted.withColumns(clean).select(
        *[b for b in by if b != "_all"],
        "step",
        F.add_months("_last", F.col("step")).alias(month),
        "forecast",
        "lower",
        "upper",
        "reason",
    )


def months_under(forecasts: DataFrame, limit: float = -100000) -> DataFrame:
    """Forecast months below the danger line."""
    return forecasts.filter(F.col("forecast") < F.lit(limit))
