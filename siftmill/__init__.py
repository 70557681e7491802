"""Observation reduction and label evaluation on Spark."""

from siftmill.schemas import (
    HINT6,
    HINT7,
    HINTS,
    HIERARCHY,
    METRICS,
    OBS9,
    OBSERVATIONS,
    ORD,
    SITE6,
    SITE7,
    SOURCES,
    TIMINGS,
    TYPE2,
    WEIGHT,
    Category,
    conform,
)
from siftmill.session import shared_folder, tune

__all__ = [
    "Category",
    "HIERARCHY",
    "HINT6",
    "HINT7",
    "HINTS",
    "METRICS",
    "OBS9",
    "OBSERVATIONS",
    "ORD",
    "SITE6",
    "SITE7",
    "SOURCES",
    "TIMINGS",
    "TYPE2",
    "WEIGHT",
    "conform",
    "shared_folder",
    "tune",
]
