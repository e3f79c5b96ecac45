"""Importing this module registers every query."""

import importlib

from stopwise.plans.registry import CATALOG

for _module in ("scans", "columns", "filters", "joins", "aggregates", "ordering", "nested", "network", "feeds",
                "learning", "timetable"):
    importlib.import_module(f"stopwise.plans.{_module}")

__all__ = ["CATALOG"]
