"""Fixed reference tables (regulatory limits, guidelines, crop coefficients).

Every table here has a constant number of rows, which is what makes ``broadcast`` safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Standard, parameter, limit, unit, category.
THRESHOLDS = (
    ("WHO", "pH", 6.5, "pH units", "drinking"),
    ("WHO", "pH", 8.5, "pH units", "drinking"),
    ("WHO", "turbidity", 1.0, "NTU", "drinking"),
    ("WHO", "turbidity", 4.0, "NTU", "drinking"),
    ("WHO", "nitrate", 50.0, "mg/L", "drinking"),
    ("WHO", "fluoride", 1.5, "mg/L", "drinking"),
    ("WHO", "arsenic", 0.01, "mg/L", "drinking"),
    ("WHO", "lead", 0.01, "mg/L", "drinking"),
    ("WHO", "total_dissolved_solids", 600.0, "mg/L", "drinking"),
    ("WHO", "e_coli", 0.0, "CFU/100mL", "drinking"),
    ("WHO", "total_coliform", 0.0, "CFU/100mL", "drinking"),
    ("WHO", "chloride", 250.0, "mg/L", "drinking"),
    ("WHO", "sulfate", 250.0, "mg/L", "drinking"),
    ("WHO", "iron", 0.3, "mg/L", "drinking"),
    ("WHO", "manganese", 0.1, "mg/L", "drinking"),
    ("WHO", "copper", 2.0, "mg/L", "drinking"),
    ("WHO", "zinc", 3.0, "mg/L", "drinking"),
    ("WHO", "ammonia", 1.5, "mg/L", "drinking"),
    ("WHO", "dissolved_oxygen", 4.0, "mg/L", "aquatic_life"),
    ("EPA", "pH", 6.5, "pH units", "drinking"),
    ("EPA", "pH", 8.5, "pH units", "drinking"),
    ("EPA", "turbidity", 1.0, "NTU", "drinking"),
    ("EPA", "turbidity", 4.0, "NTU", "drinking"),
    ("EPA", "nitrate", 10.0, "mg/L", "drinking"),
    ("EPA", "fluoride", 4.0, "mg/L", "drinking"),
    ("EPA", "fluoride", 2.0, "mg/L", "drinking"),
    ("EPA", "arsenic", 0.01, "mg/L", "drinking"),
    ("EPA", "lead", 0.015, "mg/L", "drinking"),
    ("EPA", "total_dissolved_solids", 500.0, "mg/L", "drinking"),
    ("EPA", "e_coli", 0.0, "CFU/100mL", "drinking"),
    ("EPA", "total_coliform", 0.0, "CFU/100mL", "drinking"),
    ("EPA", "chloride", 250.0, "mg/L", "drinking"),
    ("EPA", "sulfate", 250.0, "mg/L", "drinking"),
    ("EPA", "iron", 0.3, "mg/L", "drinking"),
    ("EPA", "manganese", 0.05, "mg/L", "drinking"),
    ("EPA", "copper", 1.3, "mg/L", "drinking"),
    ("EPA", "zinc", 5.0, "mg/L", "drinking"),
    ("EPA", "ammonia", 1.5, "mg/L", "aquatic_life"),
    ("EPA", "dissolved_oxygen", 5.0, "mg/L", "aquatic_life"),
    ("EU_WFD", "BOD", 3.0, "mg/L", "aquatic_life"),
    ("EU_WFD", "phosphate", 0.1, "mg/L", "aquatic_life"),
    ("EU_WFD", "nitrate", 50.0, "mg/L", "drinking"),
    ("EU_WFD", "ammonia", 0.6, "mg/L", "aquatic_life"),
    ("EU_WFD", "dissolved_oxygen", 6.0, "mg/L", "aquatic_life"),
    ("EU_WFD", "pH", 6.0, "pH units", "aquatic_life"),
    ("EU_WFD", "pH", 9.0, "pH units", "aquatic_life"),
    ("EU_WFD", "total_dissolved_solids", 1000.0, "mg/L", "aquatic_life"),
    ("EU_WFD", "turbidity", 5.0, "NTU", "drinking"),
    ("EU_WFD", "iron", 0.2, "mg/L", "drinking"),
    ("EU_WFD", "manganese", 0.05, "mg/L", "drinking"),
    ("EU_WFD", "fluoride", 1.5, "mg/L", "drinking"),
    ("EU_WFD", "lead", 0.01, "mg/L", "drinking"),
    ("EU_WFD", "copper", 2.0, "mg/L", "drinking"),
)
# Guideline screen, parameter, low, high (None = open), unit.
GUIDELINES = (
    ("ph", 6.5, 8.5, "pH units"),
    ("dissolved_oxygen", 5.0, None, "mg/L"),
    ("turbidity", 0.0, 5.0, "NTU"),
    ("nitrate", 0.0, 50.0, "mg/L"),
    ("e_coli", 0.0, 0.0, "CFU/100mL"),
    ("arsenic", 0.0, 0.01, "mg/L"),
    ("lead", 0.0, 0.01, "mg/L"),
    ("mercury", 0.0, 0.001, "mg/L"),
)
# Status limits, parameter, kind, good, moderate (range: good_min, good_max).
EQS = (
    ("Dissolved oxygen", "higher", 6.0, 4.0),
    ("BOD5", "lower", 4.0, 6.0),
    ("Phosphate", "lower", 0.1, 0.25),
    ("Nitrate", "lower", 25.0, 40.0),
    ("Ammonium", "lower", 0.3, 0.6),
    ("pH", "range", 6.0, 9.0),
)
# Sentinel codes that mean "no value".
SENTINELS = (-999.0, -9999.0, -99999.0, 9999.0, 99999.0, -999998.0, -999999.0)


def values_sql(rows: Sequence[tuple], types: list[str]) -> str:
    """The table as a VALUES list, valid in Spark SQL and in the checks."""
    def cell(v, t: str) -> str:
        return "NULL" if v is None else f"'{v}'" if t == "string" else f"CAST({v} AS DOUBLE)"
    return ", ".join("(" + ", ".join(cell(v, t) for v, t in zip(r, types)) + ")" for r in rows)


def small_table(spark: SparkSession, rows: Sequence[tuple], names: list[str], types: list[str]) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values_sql(rows, types)} AS t({', '.join(names)})")


THRESHOLD_COLS = (["standard", "parameter", "limit_value", "unit", "category"],
                  ["string", "string", "double", "string", "string"])
GUIDELINE_COLS = (["parameter", "low", "high", "unit"], ["string", "double", "double", "string"])
EQS_COLS = (["parameter", "kind", "good", "moderate"], ["string", "string", "double", "double"])


def thresholds(spark: SparkSession, standards: list[str] | None = None, parameter: str | None = None) -> DataFrame:
    df = small_table(spark, THRESHOLDS, *THRESHOLD_COLS)
    if standards:
        df = df.where(F.col("standard").isin(standards))
    return df.where(F.col("parameter") == parameter) if parameter else df


def threshold_parameters(spark: SparkSession, standard: str | None = None) -> DataFrame:
    return thresholds(spark, [standard] if standard else None).select("parameter").distinct().orderBy("parameter")


def threshold_standards(spark: SparkSession) -> DataFrame:
    return thresholds(spark).select("standard").distinct().orderBy("standard")


def guidelines(spark: SparkSession) -> DataFrame:
    return small_table(spark, GUIDELINES, *GUIDELINE_COLS)


def eqs(spark: SparkSession) -> DataFrame:
    return small_table(spark, EQS, *EQS_COLS)
