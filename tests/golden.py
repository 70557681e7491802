"""Small tables with known results."""

from __future__ import annotations

from pyspark.sql import types as T

from siftmill.schemas import HIERARCHY, HINTS, OBSERVATIONS, OBS9, ORD

FILE = "depot/plan.py"
MODULE = "depot.plan"

ORDERED = T.StructType([*OBSERVATIONS.fields, T.StructField(ORD, T.LongType(), False)])
ORDERED_HINTS = T.StructType([*HINTS.fields, T.StructField(ORD, T.LongType(), False)])

# Five sites of a depot: function, line, category, variable, and the types seen there in turn.
DEPOT = [
    ("load", 4, 2, "vehicle", ["Truck", "Van", "Truck"]),
    ("load", 6, 1, "spare", ["Bike"] * 2),
    (None, 0, 4, "fleet", ["Tanker", "Truck", "Tanker", "Tanker"]),
    ("unload", 9, 1, "queue", ["Van", "Tanker"]),
    ("test_load", 20, 1, "dummy", ["Van"] * 5 + ["Bike"]),
]

_THING = [("things", "Thing"), (None, "object")]
_ROOT = [(None, "object")]


def _depot(*names: str) -> tuple:
    return MODULE, names[0], [*[(MODULE, n) for n in names], *_THING]


# Every type with its bases in lookup order.
BASES = [
    _depot("Vehicle"),
    _depot("Truck", "Vehicle"),
    _depot("Van", "Vehicle"),
    _depot("Bike", "Vehicle"),
    _depot("Tanker", "Truck", "Vehicle"),
    (None, "int", [(None, "int"), *_ROOT]),
    (None, "str", [(None, "str"), *_ROOT]),
    ("units", "Metres", [("units", "Metres"), (None, "int"), *_ROOT]),
    ("codec", "Raster", [("codec", "Raster"), ("codec", "Codec"), *_ROOT]),
    ("codec", "Png", [("codec", "Png"), ("codec", "Raster"), ("codec", "Chunks"), ("codec", "Codec"), *_ROOT]),
    ("codec", "Jpeg", [("codec", "Jpeg"), ("codec", "Raster"), ("codec", "Blocks"), ("codec", "Codec"), *_ROOT]),
    ("views", "Panel", [("views", "Panel"), *_ROOT]),
]


def hierarchy(spark):
    return spark.createDataFrame(BASES, HIERARCHY)


def depot(spark):
    """All rows of the sites of ``DEPOT``; the place in the table is the order."""
    seen = [(f, n, c, v, t) for f, n, c, v, types in DEPOT for t in types]
    rows = [(FILE, None, "Depot", f, n, c, v, MODULE, t, i) for i, (f, n, c, v, t) in enumerate(seen)]
    return spark.createDataFrame(rows, ORDERED)


def one_site(spark, *types, file="a.py", start=0):
    """Rows of one site; a type is (module, name)."""
    rows = [(file, None, None, "f", 1, 2, "x", m, t, start + i) for i, (m, t) in enumerate(types)]
    return spark.createDataFrame(rows, ORDERED)


def orders(df) -> list[int]:
    return sorted(row[ORD] for row in df.select(ORD).collect())


def values(df, columns=OBS9) -> list[tuple]:
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)


def expected(spark, places, columns=OBS9) -> list[tuple]:
    rows = {row[ORD]: row for row in depot(spark).collect()}
    return sorted((tuple(rows[p][c] for c in columns) for p in places), key=repr)
