"""One function per analysis family with a ``method`` switch, and a registry of named analyses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from limnos.operators import agri, baseflow, catalog, changepoint, climate, dependence, ensemble, explore, extremes, flow, groundwater
from limnos.operators import indicators, learn, metrics, network, periods, quality, rating, regional, relate, screening, similarity, trend


def _switch(table: dict[str, Callable[..., DataFrame]], method: str) -> Callable[..., DataFrame]:
    if method not in table:
        raise ValueError(f"unknown method {method!r}; choose from {sorted(table)}")
    return table[method]


def flood_frequency(annual: DataFrame, method: str = "gev_lmom", **params) -> DataFrame:
    return _switch({"gev_lmom": extremes.gev_lmom, "gev_bootstrap": extremes.gev_bootstrap, "gumbel": extremes.gumbel, "lp3": extremes.lp3,
                    "weibull": extremes.weibull_low, "ema": extremes.ema_censored}, method)(annual, **params)


def separate_baseflow(daily: DataFrame, method: str = "lyne_hollick", **params) -> DataFrame:
    return _switch({"lyne_hollick": baseflow.lyne_hollick, "eckhardt": baseflow.eckhardt, "ukih": baseflow.smoothed_minima}, method)(daily, **params)


def flow_duration(daily: DataFrame, **params) -> DataFrame:
    return flow.duration_percentiles(daily, **params)


def hydrological_signatures(daily: DataFrame, **params) -> DataFrame:
    return flow.signatures(daily, **params)


def change_points(daily: DataFrame, method: str = "pelt", **params) -> DataFrame:
    return _switch({"pelt": changepoint.pelt, "cusum": changepoint.cusum, "pettitt": changepoint.pettitt, "regime": changepoint.regime_shifts,
                    "binary_segmentation": changepoint.binary_segmentation}, method)(daily, **params)


def trend_test(series: DataFrame, method: str = "original", **params) -> DataFrame:
    return trend.mann_kendall(series, **params) if method == "original" else trend.mann_kendall_modified(series, method, **params)


def copula(pairs: DataFrame, keys, **params) -> DataFrame:
    return dependence.copula_fit(pairs, keys, **params)


def bayesian_regression(df: DataFrame, xs, y, keys, **params) -> DataFrame:
    return ensemble.bayes_regression(df, xs, y, keys, **params)


def combine_models(members: DataFrame, method: str = "skill", **params) -> DataFrame:
    if method == "skill":
        return ensemble.combine(members, ensemble.skill_weights(members), **params)
    return _switch({"equal": ensemble.combine, "adaptive": ensemble.adaptive}, method)(members, **params)


def recharge(levels: DataFrame, method: str = "water_table", **params) -> DataFrame:
    return _switch({"water_table": groundwater.water_table_recharge, "balance": groundwater.balance_recharge,
                    "baseflow": groundwater.baseflow_recharge}, method)(levels, **params)


def downscale(gcm: DataFrame, obs: DataFrame, method: str = "quantile_mapping", **params) -> DataFrame:
    return climate.bias_correction(gcm, obs, method, **params)


def climate_index(df: DataFrame, method: str = "spi", **params) -> DataFrame:
    return _switch({"spi": climate.spi, "sgi": climate.sgi, "pdsi": climate.pdsi, "pci": climate.concentration_index, "heat_waves": climate.heat_waves,
                    "drought_runs": climate.drought_runs, "wet_spells": climate.wet_spells}, method)(df, **params)


_MODULES = (agri, baseflow, catalog, changepoint, climate, dependence, ensemble, explore, extremes, flow, groundwater, indicators, learn, metrics,
            network, periods, quality, rating, regional, relate, screening, similarity, trend)

# "family.operator" → callable: every public operator takes DataFrames and parameters and returns a DataFrame.
REGISTRY: dict[str, Callable] = {
    f"{m.__name__.rsplit('.', 1)[1]}.{name}": fn for m in _MODULES for name, fn in vars(m).items()
    if callable(fn) and not name.startswith("_") and getattr(fn, "__module__", "") == m.__name__ and not isinstance(fn, type)}


def run(name: str, *frames: DataFrame, **params):
    """Runs a registered operator by name."""
    return _switch(REGISTRY, name)(*frames, **params)
