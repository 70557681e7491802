import random

import pytest
from pyspark.sql import functions as F

import golden as g
from siftmill.operators import matching as m
from siftmill.schemas import HINT6

O, G = "clock.py", "rebuilt.py"

# Hints of a clock before and after: file, class, function, offset, category, name, type.
BEFORE = [
    (O, "Clock", "tick", 0, 2, "step", "int"),
    (O, "Clock", "tick", 8, 1, "now", "float"),
    (O, "Clock", "tick", 8, 1, "now", "int"),
    (O, None, None, 0, 5, "ZONE", "str"),
    (O, "Clock", None, 4, 1, "hands", "list[str]"),
    (O, None, "main", 0, 3, "main", None),
]
AFTER = [
    (G, "Clock", "tick", 0, 2, "step", "int"),
    (G, "Clock", "tick", 8, 1, "now", "int"),
    (O, "Clock", "tick", 8, 1, "now", "str"),
    (G, None, None, 0, 5, "ZONE", None),
    (G, "Clock", "tick", 8, 1, "now", "bytes"),
    (G, None, "main", 0, 3, "main", None),
    (G, None, "main", 4, 1, "extra", "int"),
]
# Equal hints meet first, then what is left by name, in order: the float of now is paired with
# str, bytes stays alone. A hint without type on both sides is equal, on one side it is missing.
SCORED = [
    ("step", 0, "int", "int", True, True),
    ("now", 8, "float", "str", True, False),
    ("now", 8, "int", "int", True, True),
    ("ZONE", 0, "str", None, False, False),
    ("hands", 4, "list[str]", None, False, False),
    ("main", 0, None, None, True, True),
    ("now", 8, None, "bytes", None, None),
    ("extra", 4, None, "int", None, None),
]


def table(spark, rows):
    return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], g.ORDERED_HINTS)


@pytest.fixture(scope="module")
def metrics(spark):
    return m.match_hints(table(spark, BEFORE), table(spark, AFTER), filenames={G: O}).cache()


@pytest.mark.parametrize("nested", [False, True])
def test_every_kind_of_pair(spark, nested):
    mapping = spark.createDataFrame([(G, O)], "generated string, original string")
    found = m.match_hints(
        table(spark, BEFORE), table(spark, AFTER), filenames=mapping, nested_occurrence=nested, chunk_rows=2
    )
    rows = m.in_report_order(found).collect()
    assert [
        (r.VarName, r.ColumnOffset, r.OriginalType, r.GeneratedType, r.Completeness, r.Correctness) for r in rows
    ] == SCORED
    assert {r.Filename for r in rows} == {O}


def test_totals(metrics):
    assert tuple(m.total_scores(metrics).first()) == (4 / 6, 3 / 4)


def test_totals_of_nothing(metrics):
    assert tuple(m.total_scores(metrics.limit(0)).first()) == (0.0, 0.0)


def test_status_counts(metrics):
    row = m.status_counts(metrics).first()
    assert (row.n_rows, row.n_original, row.n_matched, row.n_only_original, row.n_only_generated, row.n_generated) == (
        8, 6, 4, 2, 2, 6,
    )
    assert row.share_matched == 0.5


def test_file_rates_and_top(metrics):
    rates = m.file_rates(metrics)
    assert [tuple(r) for r in rates.collect()] == [(O, 4 / 6, 3 / 4)]
    assert m.top_files(rates, "completeness_rate").count() == 1


def test_null_types(spark):
    row = (O, None, "f", 0, 3, "f", None)
    both = m.match_hints(table(spark, [row]), table(spark, [row])).first()
    assert (both.Completeness, both.Correctness) == (True, True)
    ignored = m.match_hints(table(spark, [row]), table(spark, [row]), null_types="ignore").first()
    assert (ignored.Completeness, ignored.Correctness) == (None, None)


def test_duplicates_with_null_keys_stay_one_to_one(spark):
    row = (O, None, None, 0, 5, "x", "int")
    found = m.match_hints(table(spark, [row] * 4), table(spark, [row] * 6), chunk_rows=2).collect()
    assert len(found) == 6
    assert sorted(r._ord_generated for r in found) == list(range(6))
    assert sum(r.Correctness is True for r in found) == 4


def brute_force(original, generated):
    """Exact matches first, then what is left by key, both in order."""
    result, used = [], set()
    rest = []
    for i, row in enumerate(original):
        j = next((j for j, other in enumerate(generated) if j not in used and other == row), None)
        if j is None:
            rest.append(i)
        else:
            used.add(j)
            result.append((i, j))
    for i in rest:
        j = next((j for j, o in enumerate(generated) if j not in used and o[:6] == original[i][:6]), None)
        if j is not None:
            used.add(j)
        result.append((i, j))
    result += [(None, j) for j in range(len(generated)) if j not in used]
    return sorted(result, key=repr)


@pytest.mark.parametrize("hot_rows", [0, 20, m.HOT_ROWS])
def test_against_brute_force(spark, hot_rows, monkeypatch):
    """All keys hot, some, none: the same pairs."""
    monkeypatch.setattr(m, "HEAT_FACTOR", 0)
    dice = random.Random(7)

    def hint():
        # one row makes up a third of the table
        if dice.random() < 0.33:
            return (O, None, None, 0, 5, "hot", "int")
        return (O, dice.choice([None, "C"]), None, 0, 5, dice.choice("ab"), dice.choice([None, "int", "str"]))

    original, generated = [hint() for _ in range(150)], [hint() for _ in range(120)]
    found = m.match_hints(table(spark, original), table(spark, generated), chunk_rows=16, hot_rows=hot_rows)
    # which copy of a leftover type meets which is a matter of order by key, so compare exact pairs and the counts
    pairs = sorted(((r._ord_original, r._ord_generated) for r in found.collect()), key=repr)
    wanted = brute_force(original, generated)
    assert pairs == wanted
    assert len(HINT6) == 6


def test_split_by_heat(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), "id")
    cold, hot = m.split_by_heat(rows, ["k"], hot_rows=1000)
    # keys that share the bucket of the hot one go with it
    assert hot.where("k IS NULL").count() == 10_000 and 10_000 <= hot.count() < 10_020
    assert cold.where("k IS NULL").isEmpty() and cold.count() + hot.count() == 30_000
    assert m.split_by_heat(rows, ["k"])[1].isEmpty()


def test_rows_are_dealt_out_once(spark):
    """Of the plan for keys that are not hot: one exchange by key, everything else follows in the same tasks."""
    cold = m._tagged(table(spark, BEFORE), table(spark, AFTER), HINT6, "Type", "_ord")
    text = m._pairs_by_key(cold, HINT6, "Type")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("Window") >= 2
