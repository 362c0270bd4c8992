"""Loads every plan module, so the registry is full."""

from . import areas, columns, estimates, exposures, ranking, searching, spatials, incidents, intake, lookups, refreshing, sourced  # noqa: F401
from .registry import QUERIES  # noqa: F401
