"""Queries over the driver tables with their SQL; every module adds its own to driver.QUERIES and driver.ORACLES."""

from . import driver, extra, forests, genes, graphs, more, rearranged, sequences  # noqa: F401
