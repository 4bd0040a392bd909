"""FAO-56 reference evapotranspiration as column expressions (numbers are the equation constants)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def svp(t: Column) -> Column:
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def slope(t: Column) -> Column:
    return 4098 * svp(t) / F.pow(t + 237.3, 2)


def pressure(z: Column) -> Column:
    return 101.3 * F.pow((293.0 - 0.0065 * z) / 293.0, 5.26)


def gamma(z: Column) -> Column:
    return 0.665e-3 * pressure(z)


def extraterrestrial(lat: Column, doy: Column) -> Column:
    phi, a = F.radians(lat), 2 * math.pi * doy / 365
    dr, delta = 1 + 0.033 * F.cos(a), 0.409 * F.sin(a - 1.39)
    ws = F.acos(-F.tan(phi) * F.tan(delta))
    return 24 * 60 / math.pi * 0.0820 * dr * (ws * F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.sin(ws))


def clear_sky(ra: Column, z: Column) -> Column:
    return (0.75 + 2e-5 * z) * ra


def net_shortwave(rs: Column, albedo: float = 0.23) -> Column:
    return (1 - albedo) * rs


def net_longwave(t_min: Column, t_max: Column, ea: Column, rs: Column, rso: Column) -> Column:
    ratio = F.when(rso > 0, F.least(rs / rso, F.lit(1.0))).otherwise(0.5)
    k4 = (F.pow(t_max + 273.16, 4) + F.pow(t_min + 273.16, 4)) / 2
    return 4.903e-9 * k4 * (0.34 - 0.14 * F.sqrt(ea)) * (1.35 * ratio - 0.35)


def net_radiation(t_min: Column, t_max: Column, ea: Column, rs: Column, rso: Column) -> Column:
    return net_shortwave(rs) - net_longwave(t_min, t_max, ea, rs, rso)


def vapour(t_min: Column, t_max: Column, rh_min: Column, rh_max: Column) -> Column:
    return (svp(t_min) * rh_max / 100 + svp(t_max) * rh_min / 100) / 2


def penman_monteith(t_min: Column, t_max: Column, rh_min: Column, rh_max: Column, wind: Column, rs: Column, lat: Column,
                    z: Column, doy: Column) -> Column:
    t = (t_min + t_max) / 2
    ea, es = vapour(t_min, t_max, rh_min, rh_max), (svp(t_min) + svp(t_max)) / 2
    rn = net_radiation(t_min, t_max, ea, rs, clear_sky(extraterrestrial(lat, doy), z))
    d, g = slope(t), gamma(z)
    return F.greatest(F.lit(0.0), (0.408 * d * rn + g * 900 / (t + 273) * wind * (es - ea)) / (d + g * (1 + 0.34 * wind)))


def hargreaves(t_min: Column, t_max: Column, ra: Column) -> Column:
    return 0.0023 * ((t_min + t_max) / 2 + 17.8) * F.sqrt(F.greatest(t_max - t_min, F.lit(0.0))) * ra * 0.408
