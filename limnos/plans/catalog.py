"""Registration of checked queries: a Spark plan over the driver tables plus, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def R(expr: str, n: int = 4) -> str:
    """Rounded SQL value without negative zero."""
    return f"(round({expr}, {n}) + 0.0)"


NUDGE = 3e-10  # moves exact half-way decimals off the rounding edge, the same way in both engines


def N(expr: str, n: int = 6) -> str:
    """Rounded SQL value that does not depend on how an engine rounds half-way decimals."""
    return f"(round(({expr}) + {NUDGE!r}::DOUBLE, {n}) + 0.0)"


def nudged(df, n, *cols):
    from pyspark.sql import functions as F
    return df.select(*[F.round(F.col(c) + NUDGE, n).alias(c) if c in cols else F.col(c) for c in df.columns])
