"""Checked queries over the driver tables, by family."""

from importlib import import_module

FAMILIES = ("observations", "pairs", "hydrology", "trends", "relational", "climate", "land", "frequency", "spatial", "loading")

for _family in FAMILIES:
    import_module(f"limnos.plans.{_family}")
