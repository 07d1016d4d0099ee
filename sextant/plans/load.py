"""Importing this module registers every plan."""

from sextant.plans import basics, calibration, experiments, formats, grid, increments, panels, populations, relational, reports, signals, slice, studies, timeseries, warehouse  # noqa: F401
