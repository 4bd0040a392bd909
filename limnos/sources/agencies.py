"""Field mappings of agency exports: one mapper, one entry of SQL expressions per agency.

An entry maps landed JSON or CSV columns to the canonical observation columns. Rows whose time or
value does not parse are dropped, as a bad record must not stop a load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGETS = ("station_id", "station_name", "parameter", "ts", "value", "unit", "latitude", "longitude", "basin", "river", "county")
CANONICAL_TYPES = {"ts": "TIMESTAMP", "value": "DOUBLE", "latitude": "DOUBLE", "longitude": "DOUBLE"}


def _plain(station: str, time: str, value: str, parameter: str, unit: str, **more: str) -> dict[str, str]:
    return {"station_id": station, "ts": time, "value": value, "parameter": parameter, "unit": unit, **more}


# Field names of the agencies' exports.
AGENCIES: dict[str, dict[str, str]] = {
    "usgs": _plain("properties.monitoring_location_id", "properties.time", "properties.value", "properties.parameter_code", "properties.unit_of_measure",
                   latitude="geometry.coordinates[1]", longitude="geometry.coordinates[0]"),
    "uk_ea": _plain("station_id", "dateTime", "value", "observedProperty", "unitName", latitude="lat", longitude="long"),
    "france_hubeau": _plain("code_station", "date_obs", "CASE grandeur_hydro WHEN 'Q' THEN resultat_obs / 1000 WHEN 'H' THEN resultat_obs / 1000 ELSE resultat_obs END",
                            "CASE grandeur_hydro WHEN 'Q' THEN 'discharge' WHEN 'H' THEN 'water_level' ELSE grandeur_hydro END", "CASE grandeur_hydro WHEN 'Q' THEN 'm3/s' ELSE 'm' END"),
    "pegelonline": _plain("uuid", "timestamp", "CASE WHEN shortname = 'W' THEN value / 100 ELSE value END", "CASE WHEN shortname = 'W' THEN 'water_level' ELSE 'discharge' END",
                          "CASE WHEN shortname = 'W' THEN 'm' ELSE unit END", station_name="longname", river="water"),
    "ireland_opw": _plain("station_ref", "datetime", "value", "'water_level'", "'m'", station_name="station_name"),
    "noaa_nwps": _plain("lid", "validTime", "secondary * 28.316846592", "'discharge'", "'m3/s'"),
    "bom": _plain("station_no", "timestamp", "CASE WHEN trim(value) IN ('', 'NaN', '--') THEN NULL ELSE value END", "parameter_type", "unit", station_name="station_name"),
    "japan_mlit": _plain("station_id", "coalesce(datetime, date)", "CASE WHEN trim(value) IN ('', '-', 'ND', '--') THEN NULL ELSE value END", "parameter", "unit", river="river_system"),
    "korea_wamis": _plain("station_id", "coalesce(datetime, date, ymdhm)", "CASE WHEN trim(value) IN ('', '-', 'ND', '--') THEN NULL ELSE value END", "parameter", "unit",
                          latitude="coalesce(latitude, lat)", longitude="coalesce(longitude, lon)"),
    "india_wris": _plain("stationCode", "dataTime", "dataValue", "'water_level'", "coalesce(unit, 'm')", station_name="stationName"),
    "taiwan_cwa": _plain("station_id", "day.DataDate", "day.Precipitation.Accumulation", "'precipitation'", "'mm'"),
    "taiwan_moenv": _plain("sitename", "concat(sampledate, ' ', coalesce(sampletime, '00:00'))", "CASE WHEN itemvalue IN ('', '-', 'ND', '--') THEN NULL ELSE itemvalue END",
                           "coalesce(itemengabbreviation, itemname)", "coalesce(itemunit, 'mg/L')", latitude="twd97lat", longitude="twd97lon", basin="basin", river="river", county="county"),
    "taiwan_civil_iot": _plain("Thing.name", "Observations[0].phenomenonTime", "Observations[0].result", "coalesce(name, description)", "unitOfMeasurement.symbol"),
    "taiwan_datagov": _plain("coalesce(StationIdentifier, StationNo, SiteId)", "coalesce(RecordTime, ObservationTime, DateTime)", "coalesce(WaterLevel, GWLevel)", "'water_level'", "'m'"),
    "taiwan_wra": _plain("coalesce(StationIdentifier, ST_NO)", "RecordTime", "WaterLevel", "'water_level'", "'m'", station_name="StationName"),
    "taiwan_wra_fhy": _plain("StationIdentifier", "coalesce(RecordTime, ObservationTime)", "CASE WHEN trim(Value) IN ('', '-', '--', 'ND') THEN NULL ELSE Value END", "data_type", "unit"),
    "taiwan_wra_iot": _plain("coalesce(StationNo, StationIdentifier)", "coalesce(RecordTime, ObservationTime)", "CASE WHEN trim(Value) IN ('', '-', '--', 'ND') THEN NULL ELSE Value END", "data_type", "unit"),
    "eu_wfd": _plain("monitoringSiteIdentifier", "phenomenonTimeSamplingDate", "resultMeanValue", "observedPropertyDeterminandLabel", "resultUom", latitude="lat", longitude="lon"),
    "copernicus": _plain("concat('copernicus_', latitude, '_', longitude)", "datetime", "value", "variable", "'m3/s'", latitude="latitude", longitude="longitude"),
}


def normalise(df: DataFrame, agency: str) -> DataFrame:
    """Landed rows of one agency → canonical observations."""
    spec = AGENCIES[agency]
    cols = [F.lit(agency).alias("source")]
    for t in TARGETS:
        kind = CANONICAL_TYPES.get(t, "STRING")
        text = f"try_cast(({spec[t]}) AS {kind})" if t in spec else f"CAST(NULL AS {kind})"
        if t == "ts":
            text = f"try_to_timestamp(regexp_replace(CAST(({spec[t]}) AS STRING), 'Z$', ''))"
        cols.append(F.expr(text).alias(t))
    return df.select(*cols).where("ts IS NOT NULL AND value IS NOT NULL AND station_id IS NOT NULL")
