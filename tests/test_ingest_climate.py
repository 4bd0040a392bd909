"""Column decisions of messy tables and the climate of points, by hand-made frames."""

import datetime as dt
import math

from limnos.operators import climate
from limnos.sources import readers


def decided(spark, rows, names, **options):
    d = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    return readers.decide_mapping(d, **options).collect()[0].asDict()


def test_decision_reads_names_units_and_repeats(spark):
    rows = [(f"S{i % 2}", f"{1 + i // 28:02d}/{1 + i % 28:02d}/2001", f"{i},5", "P", str(i)) for i in range(80)]
    r = decided(spark, rows, ["site_no", "Date", "streamflow cfs", "qual_code", "row id"])
    assert (r["date_column"], r["value_column"], r["variable"], r["unit"], r["station_column"]) == ("Date", "streamflow cfs", "discharge", "m3/s", "site_no")
    assert math.isclose(r["to_si_factor"], 0.028316846592) and math.isclose(r["confidence"], 0.95) and r["date_share"] == 1
    # a station id that never repeats is no station, a level in feet is scaled, a variable given stays
    rows = [(str(i), f"2001-01-{1 + i % 28:02d} 10:00", str(i / 3)) for i in range(50)]
    r = decided(spark, rows, ["gauge", "when", "stage (ft)"])
    assert (r["date_column"], r["value_column"], r["variable"], r["unit"], r["to_si_factor"], r["station_column"]) == ("when", "stage (ft)", "water_level", "m", 0.3048, None)
    assert decided(spark, rows, ["gauge", "when", "x"], variable="precipitation")["unit"] == "mm"


def test_decision_without_dates_numbers_or_rows(spark):
    r = decided(spark, [("a", "1"), ("b", "2")], ["name", "value"])
    assert r["date_column"] is None and r["value_column"] == "value" and r["confidence"] == 0
    r = decided(spark, [("2001-01-01", "n/a"), ("2001-01-02", None)], ["date", "note"])
    assert r["date_column"] == "date" and r["value_column"] is None and r["confidence"] == 0
    r = decided(spark, [], ["date", "flow"])
    assert r["date_column"] is None and r["value_column"] is None and r["confidence"] == 0


def test_flags_and_ties_of_columns(spark):
    rows = [("2001-01-01", "2001-01-01", "1", "2", "3")] * 3
    r = decided(spark, rows, ["a", "b", "discharge flag", "x", "y"])
    assert (r["date_column"], r["value_column"]) == ("a", "discharge flag")  # 1 + 1 - 0.8 is still the best of them
    assert decided(spark, rows, ["a", "b", "flag", "x", "y"])["value_column"] == "x"


def days(spark, rows):
    return spark.createDataFrame(rows, "station_id string, date date, value double")


def test_point_climate_by_hand(spark):
    year = [dt.date(2001, 1, 1) + dt.timedelta(i) for i in range(365)]
    part = [dt.date(2002, 1, 1) + dt.timedelta(i) for i in range(100)]
    p = days(spark, [("a", d, 2.0 if d.month < 7 else 1.0) for d in year] + [("a", d, 9.0) for d in part] + [("b", part[0], 4.0), ("b", part[1], None)])
    e = days(spark, [("a", d, 4.0) for d in year])
    t = days(spark, [("a", d, 10.0) for d in year] + [("a", d, None) for d in part])
    by = {r.station_id: r for r in climate.point_climate(p, e, t).collect()}
    a, b = by["a"], by["b"]
    first, second = 181, 184
    assert a.precipitation_per_year == 2 * first + second and a.et0_per_year == 4 * 365
    assert math.isclose(a.aridity_index, (2 * first + second) / (4 * 365)) and a.aridity_class == "semi-arid"
    assert a.temperature_mean == 10 and a.wettest_day == 9 and [(y.year, y.mm) for y in a.annual_precipitation] == [(2001, 546.0)]
    assert math.isclose(a.monthly_precipitation[0], (31 * 2 + 31 * 9) / 62 * 30.44) and math.isclose(a.monthly_precipitation[11], 30.44)
    assert all(math.isclose(x, 4 * 30.44) for x in a.monthly_et0)
    assert b.precipitation_per_year is None and b.aridity_class is None and b.annual_precipitation == [] and b.wettest_day == 4
    assert math.isclose(b.monthly_precipitation[0], 4 * 30.44) and b.monthly_precipitation[1] is None and b.monthly_et0 == [None] * 12
    assert climate.point_climate(p, e).where("station_id = 'a'").first().temperature_mean is None
