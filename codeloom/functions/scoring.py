"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Rounded half up, towards plus infinity."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def scaled(value: Column, low: float, mid: float, high: float, top: float) -> Column:
    """0 up to ``low``, 10 from ``top``; linear to 5 at ``mid``, 8 at ``high``, 10 at ``top``."""
    x = value.cast("double")
    return (
        F.when(x <= low, 0.0)
        .when(x >= top, 10.0)
        .when(x <= mid, 5.0 * (x - low) / (mid - low))
        .when(x <= high, 5.0 + 3.0 * (x - mid) / (high - mid))
        .otherwise(8.0 + 2.0 * (x - high) / (top - high))
    )


def bus_factor(authors: Column) -> Column:
    """10 for one author, 5 for two, 2 for three, else 0."""
    return F.when(authors == 1, 10.0).when(authors == 2, 5.0).when(authors == 3, 2.0).otherwise(0.0)


def risk_level(score: Column) -> Column:
    return F.when(score >= 8, "CRITICAL").when(score >= 6, "HIGH").when(score >= 3, "MEDIUM").otherwise("LOW")
