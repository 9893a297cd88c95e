"""Imports every module of queries, so that the catalogue is filled."""

from __future__ import annotations

import importlib

from lumenfold.plans.catalog import ORACLES, QUERIES

MODULES = ("signal", "hist", "colors", "ledger", "frames", "volumes", "models", "lattice", "measures", "generators", "stores", "refinements", "exports", "rounds", "pictures", "margins")

for _name in MODULES:
    importlib.import_module(f"lumenfold.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
