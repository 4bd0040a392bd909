"""Row-level hydrological expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def runoff_mm(q_m3s: Column, area_km2: Column) -> Column:
    """Daily runoff depth; null without a positive area."""
    return F.when(area_km2 > 0, q_m3s * 86400 / (area_km2 * 1e6) * 1000)
