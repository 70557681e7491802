import random

import pytest

from siftmill.operators import hierarchy
from siftmill.operators.hierarchy import hierarchy_from_edges, update_hierarchy
from siftmill.session import written

SCHEMA = "module string, type string, base_module string, base_type string, position long"


def edges_of(classes):
    return [
        ("m", name, "m" if base in classes else None, base, place)
        for name, bases in classes.items()
        for place, base in enumerate(bases or [None])
    ]


def by_python(classes):
    """Lookup orders of classes made on the fly, null where Python refuses them."""
    made, orders = {"object": object}, {}
    for name, bases in classes.items():
        try:
            made[name] = type(name, tuple(made[b] for b in bases), {})
            orders[name] = [c.__name__ for c in made[name].__mro__]
        except (TypeError, KeyError):
            continue
    return orders


@pytest.mark.parametrize("seed", [1, 2])
def test_against_python(spark, seed):
    dice = random.Random(seed)
    classes = {}
    for i in range(30):
        known = list(classes)
        classes[f"C{i}"] = dice.sample(known, min(len(known), dice.choice([0, 1, 2, 2, 3])))
    table, missing = hierarchy_from_edges(spark.createDataFrame(edges_of(classes), SCHEMA))
    found = {r.type: [b.type for b in r.bases] for r in table.collect() if r.module == "m"}
    wanted = by_python(classes)
    assert found == wanted
    assert {r.type for r in missing.collect()} == set(classes) - set(wanted)


def test_cycles_and_unknown_bases(spark):
    rows = [("m", "A", "m", "B", 0), ("m", "B", "m", "A", 0), ("m", "C", "x", "Nowhere", 0), ("m", "D", None, None, 0)]
    table, missing = hierarchy_from_edges(spark.createDataFrame(rows, SCHEMA))
    assert {r.type for r in table.collect()} == {"object", "D"}
    assert {r.type for r in missing.collect()} == {"A", "B", "C"}


def test_no_depth_is_too_deep(spark):
    """More than two hundred levels, with two bases half way."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        classes = {f"D{i}": [f"D{i - 1}"] if i else [] for i in range(110)}
        classes["Other"] = []
        classes["E0"] = ["D109", "Other"]
        classes |= {f"E{i}": [f"E{i - 1}"] for i in range(1, 110)}
        table, missing = hierarchy_from_edges(spark.createDataFrame(edges_of(classes), SCHEMA))
        found = {r.type: [b.type for b in r.bases] for r in table.collect() if r.module == "m"}
        assert found == by_python(classes) and missing.isEmpty()
        assert max(map(len, found.values())) == 222
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def orders(table):
    return {(r.module, r.type): [tuple(b) for b in r.bases] for r in table.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_update_equals_a_rebuild(spark, seed, monkeypatch):
    dice = random.Random(seed)
    classes = {}
    for i in range(40):
        known = list(classes)
        classes[f"C{i}"] = dice.sample(known, min(len(known), dice.choice([0, 1, 1, 2, 3])))
    later = dict(classes)
    for name in dice.sample(list(classes), 4):  # other bases, in another order, or gone
        kind = dice.choice(["gone", "others", "turned"])
        if kind == "gone":
            del later[name]
        else:
            later[name] = list(reversed(classes[name])) if kind == "turned" else dice.sample(list(classes)[: int(name[1:])], min(int(name[1:]), 2))
    later["New"] = ["C39"] if "C39" in later else []
    old, new = (spark.createDataFrame(edges_of(c), SCHEMA) for c in (classes, later))
    stored = written(hierarchy_from_edges(old)[0], "stored")
    wanted, without = hierarchy_from_edges(new)
    table, missing = update_hierarchy(stored, new, old)
    assert orders(table) == orders(wanted)
    assert {r.type for r in missing.collect()} == {r.type for r in without.collect()}


def test_update_works_out_descendants_only(spark, monkeypatch):
    classes = {f"A{i}": [f"A{i - 1}"] if i else [] for i in range(20)} | {f"B{i}": [f"B{i - 1}"] if i else [] for i in range(20)}
    later = classes | {"A15": ["B3"]}
    old, new = (spark.createDataFrame(edges_of(c), SCHEMA) for c in (classes, later))
    stored = written(hierarchy_from_edges(old)[0], "stored")
    seen = []
    plain = hierarchy._settle
    monkeypatch.setattr(hierarchy, "_settle", lambda links, known: seen.append(sorted(r.id for r in links.collect())) or plain(links, known))
    table, _ = update_hierarchy(stored, new, old)
    assert seen == [[f"m:A{i}" for i in range(15, 20)]]
    assert orders(table) == orders(hierarchy_from_edges(new)[0])
