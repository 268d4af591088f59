"""Forecasts of short series, one series in a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _residuals(d: np.ndarray, phi: float, theta: float) -> np.ndarray:
    """Errors of an ARMA(1, 1) model of the differences, the first value given."""
    e = np.zeros(len(d))
    for t in range(1, len(d)):
        e[t] = d[t] - phi * d[t - 1] - theta * e[t - 1]
    return e


def fitted(y: np.ndarray) -> tuple[float, float, float]:
    """Forecast and band of 1.96 deviations by ARIMA(1, 1, 1): least squares of the errors over a grid that is refined four times."""
    d = np.diff(y)
    phi = theta = 0.0
    for width in (0.9, 0.3, 0.1, 0.03):
        tries = [(min(0.98, max(-0.98, phi + a)), min(0.98, max(-0.98, theta + b))) for a in np.linspace(-width, width, 7) for b in np.linspace(-width, width, 7)]
        phi, theta = min(tries, key=lambda x: (float((_residuals(d, *x) ** 2).sum()), abs(x[0]) + abs(x[1])))
    e = _residuals(d, phi, theta)
    sigma = float(np.sqrt((e[1:] ** 2).mean())) if len(d) > 1 else 0.0
    at = float(y[-1] + phi * d[-1] + theta * e[-1])
    return at, at - 1.96 * sigma, at + 1.96 * sigma


def arima(series: DataFrame, by: str, order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """``(by, method, forecast, lower, upper)``: ARIMA(1, 1, 1) from three values on, else exponential smoothing; nothing is below 0."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].to_numpy(float)
        if len(y) >= 3:
            at, low, high = fitted(y)
            method = "arima"
        else:
            w = alpha * (1 - alpha) ** np.arange(len(y))[::-1]
            at = low = high = float((w * y).sum() / w.sum())
            method = "smoothing"
        return pd.DataFrame({by: [pdf[by].iloc[0]], "method": [method], "forecast": [max(at, 0.0)], "lower": [max(low, 0.0)], "upper": [max(high, 0.0)]})

    kind = series.schema[by].dataType.simpleString()
    return series.select(by, order, value).groupBy(by).applyInPandas(solve, f"{by} {kind}, method string, forecast double, lower double, upper double")
