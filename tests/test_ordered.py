import random

import pytest
from pyspark.sql import functions as F

from siftmill.operators import changes, ordered
from siftmill.schemas import ORD


@pytest.fixture(scope="module")
def rows(spark):
    dice = random.Random(3)
    data = [
        (i, "hot" if dice.random() < 0.4 else dice.choice(["a", "b", None]), dice.randint(0, 2), dice.choice([None, 1, 2]))
        for i in range(400)
    ]
    return spark.createDataFrame(data, f"{ORD} long, k string, v long, w long").repartition(5).cache()


def in_order(rows):
    return sorted((r for r in rows.collect()), key=lambda r: r[ORD])


@pytest.mark.parametrize("chunk_rows", [1, 7, 50, 100_000])
def test_running_sum_and_numbers(rows, chunk_rows):
    sums, counts = {}, {}
    for row in in_order(ordered.running_sum(rows, ["k"], F.col("v"), "s", chunk_rows=chunk_rows)):
        sums[row.k] = sums.get(row.k, 0) + row.v
        assert row.s == sums[row.k]
    for row in in_order(ordered.occurrence_number(rows, ["k", "w"], "n", chunk_rows=chunk_rows)):
        assert row.n == counts.get((row.k, row.w), 0)
        counts[row.k, row.w] = row.n + 1


@pytest.mark.parametrize("chunk_rows", [1, 7, 50, 100_000])
def test_previous(rows, chunk_rows):
    last = {}
    for row in in_order(ordered.previous(rows, ["k"], ["w"], "p", chunk_rows=chunk_rows)):
        assert (None if row.p is None else (row.p.w,)) == last.get(row.k)
        last[row.k] = (row.w,)


def test_struct_order(spark):
    data = [(("a", i), "k") for i in range(5)] + [(("b", i), "k") for i in range(5)]
    df = spark.createDataFrame(data, f"{ORD} struct<file:string,row:long>, k string")
    found = ordered.occurrence_number(df, ["k"], "n", chunk_rows=2).collect()
    assert [r.n for r in sorted(found, key=lambda r: (r[ORD].file, r[ORD].row))] == list(range(10))


def test_order_must_have_chunks(spark):
    with pytest.raises(TypeError):
        ordered.occurrence_number(spark.createDataFrame([("x", 1)], f"{ORD} string, k long"), ["k"])


def gate(rows, until):
    """Row by row, as one would do it while observing."""
    kept, shown, iteration, last_count, quiet, stopped = [], set(), -1, 0, 0, False
    for order, head, what in rows:
        if stopped:
            continue
        if head:
            iteration += 1
            if iteration > 0:
                quiet = 0 if len(shown) != last_count else quiet + 1
                last_count = len(shown)
        # the head that finds the loop stable is still kept
        stopped = quiet >= until
        kept.append(order)
        shown.add(what)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_stable_loops_against_step_by_step(spark, seed):
    dice = random.Random(seed)
    rows = []
    for i in range(300):
        rows.append((i, i % 3 == 0, dice.choice("abcdefghij"[: 1 + i // 40])))
    df = spark.createDataFrame(rows, f"{ORD} long, head boolean, what string").withColumn("loop", F.lit("l"))
    numbered = changes.numbered_iterations(df, ["loop"], "head", chunk_rows=20)
    found = changes.until_stable_loops(numbered, ["loop"], ["what"], is_head="head", chunk_rows=3)
    assert sorted(r[ORD] for r in found.collect()) == gate(rows, 5)
